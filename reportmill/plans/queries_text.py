"""Registered queries: sources, projections, text functions and corpus analytics on the documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reportmill.functions import text as X
from reportmill.operators import profile as P
from reportmill.operators import relational as R
from reportmill.plans.corpora import NORM_SQL, TOKENS_SQL, docs
from reportmill.plans.registry import register
from reportmill.sources.tables import table


def norm():
    return X.normalize(F.col("report"))


def words():
    return X.tokens(norm())



@register("src_01_typed_scan", "SELECT CAST(doc_id AS VARCHAR) AS study, lang, source, n_chars FROM documents")
def src_01(spark, d):
    return docs(spark, d).select(F.col("study").cast("string").alias("study"), "lang", "source", "n_chars")


@register("src_02_pruned_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000")
def src_02(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").where("o_totalprice > 100000")


@register("src_03_coercing_cast", "SELECT event_id, TRY_CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS number FROM events")
def src_03(spark, d):
    return table(spark, d, "events").select("event_id", F.regexp_extract("props", "[0-9]+", 0).try_cast("bigint").alias("number"))


@register("src_09_keys_of_labelled", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def src_09(spark, d):
    known = table(spark, d, "labels").select("doc_id")
    return table(spark, d, "documents").select("doc_id").join(known, "doc_id", "left_anti")


@register("txt_01_normalize", f"SELECT doc_id AS study, sha256({NORM_SQL}) AS normal_sha256 FROM documents")
def txt_01(spark, d):
    return docs(spark, d).select("study", X.sha256(norm()).alias("normal_sha256"))


@register(
    "txt_03_contains_terms",
    rf"SELECT doc_id AS study, regexp_matches({NORM_SQL}, '(^|[^\p{{L}}\p{{N}}_])(the|und|pour)([^\p{{L}}\p{{N}}_]|$)') AS has_term FROM documents",
)
def txt_03(spark, d):
    return docs(spark, d).select("study", X.contains_terms(norm(), ("the", "und", "pour")).alias("has_term"))


@register(
    "txt_04_spans",
    rf"""WITH n AS (SELECT doc_id, {NORM_SQL} AS t FROM documents),
    w AS (SELECT doc_id, unnest(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+')) AS part, generate_subscripts(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), 1) AS i FROM n),
    p AS (SELECT doc_id, part, coalesce(sum(length(part)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM w)
    SELECT doc_id AS study, CAST(s AS INT) AS s, CAST(s + length(part) AS INT) AS e, part AS term FROM p WHERE part IN ('the', 'und', 'pour')""",
)
def txt_04(spark, d):
    found = X.spans(norm(), X.term_pattern(("the", "und", "pour")))
    return docs(spark, d).select("study", F.inline(found)).select("study", "s", "e", F.col("t").alias("term"))


_SCORE = " + ".join
_MARKS = {k: v for k, v in X.LANGUAGE_MARKERS.items()}


def _language_sql() -> str:
    def one(mark: str) -> str:
        m = mark.replace("'", "''")
        return f"(length(p) - length(replace(p, '{m}', ''))) // {len(mark)}"

    scores = ", ".join(f"{{'n': {_SCORE(map(one, marks))}, 'name': '{name}'}}" for name, marks in _MARKS.items())
    return rf"""WITH n AS (SELECT doc_id, {NORM_SQL} AS t FROM documents), m AS (SELECT doc_id, t, ' ' || t || ' ' AS p, greatest(1, len(regexp_extract_all(t, '\p{{L}}'))) AS letters FROM n),
    b AS (SELECT doc_id, t, letters, list_max([{scores}]) AS best FROM m)
    SELECT doc_id AS study, CASE WHEN t = '' THEN 'empty' WHEN len(regexp_extract_all(t, '\p{{Greek}}')) / letters >= 0.08 THEN 'greek_script'
      WHEN len(regexp_extract_all(t, '\p{{Cyrillic}}')) / letters >= 0.08 THEN 'cyrillic_script' WHEN best.n > 0 THEN best.name ELSE 'latin_other' END AS language_group FROM b"""


LANGUAGE_SQL = _language_sql()


@register("txt_07_language_group", LANGUAGE_SQL)
def txt_07(spark, d):
    return docs(spark, d).select("study", X.language_group(norm()).alias("language_group"))


@register(
    "txt_08_language_hypotheses",
    f"WITH g AS ({LANGUAGE_SQL}) SELECT study, CASE WHEN language_group = 'english' THEN 'english' ELSE language_group || '|english' END AS hypotheses FROM g",
)
def txt_08(spark, d):
    return docs(spark, d).select("study", F.array_join(X.language_hypotheses(norm()), "|").alias("hypotheses"))


@register("txt_10_tokens", f"SELECT doc_id AS study, CAST(len({TOKENS_SQL}) AS INT) AS n_tokens, sha256(array_to_string({TOKENS_SQL}, ' ')) AS tokens_sha256 FROM documents")
def txt_10(spark, d):
    found = docs(spark, d).select("study", X.let(words(), lambda w: F.struct(F.size(w).alias("n_tokens"), X.sha256(F.array_join(w, " ")).alias("tokens_sha256"))).alias("x"))
    return found.select("study", "x.*")


@register("txt_11_number_mask", None)
def txt_11(spark, d):
    return docs(spark, d).select("study", X.sha256(X.mask_numbers(F.col("report"))).alias("masked_sha256"))


@register("txt_12_single_spaced", r"SELECT doc_id AS study, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS spaced_sha256 FROM documents")
def txt_12(spark, d):
    return docs(spark, d).select("study", X.sha256(X.single_spaced(F.col("report"))).alias("spaced_sha256"))


@register("txt_15_text_hash", "SELECT doc_id AS study, sha256(text) AS text_sha256, sha256(CAST(doc_id AS VARCHAR) || ':' || source) AS key_sha256 FROM documents")
def txt_15(spark, d):
    return docs(spark, d).select("study", X.sha256(F.col("report")).alias("text_sha256"), X.sha256(F.concat_ws(":", F.col("study").cast("string"), "source")).alias("key_sha256"))


@register("txt_17_span_gap", "SELECT l_orderkey, l_linenumber, greatest(0, l_quantity - (l_linenumber + 3), l_linenumber - (l_quantity + 5)) AS gap FROM lineitem")
def txt_17(spark, d):
    a = F.struct(F.col("l_linenumber").alias("s"), (F.col("l_linenumber") + 3).alias("e"))
    b = F.struct(F.col("l_quantity").alias("s"), (F.col("l_quantity") + 5).alias("e"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", X.span_gap(a, b).alias("gap"))


_BIGRAMS_SQL = f"WITH t AS (SELECT {TOKENS_SQL} AS w FROM documents), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM t)"


@register("txt_27_bigram_counts", f"{_BIGRAMS_SQL} SELECT gram, count(*) AS n FROM g GROUP BY gram")
def txt_27(spark, d):
    return P.gram_counts(docs(spark, d), "report", 2)


@register(
    "agg_24_pair_similarity",
    f"""WITH few AS (SELECT doc_id, list_distinct({TOKENS_SQL}) AS w FROM documents ORDER BY sha256('7:' || CAST(doc_id AS VARCHAR)) LIMIT 40),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(list_intersect(a.w, b.w)) AS i, len(list_distinct(a.w || b.w)) AS u FROM few a JOIN few b ON a.doc_id < b.doc_id)
    SELECT a, b, CASE WHEN u = 0 THEN 1.0::DOUBLE ELSE i / u END AS similarity FROM p""",
)
def agg_24(spark, d):
    return P.sampled_pairs(docs(spark, d), "study", "report", 7, 40)


@register("txt_31_presence_rates", r"SELECT lang, avg(CASE WHEN regexp_matches(text, '(?i)\bthe\b') THEN 100.0 ELSE 0.0 END) AS has_the, avg(CASE WHEN contains(text, chr(10)) THEN 100.0 ELSE 0.0 END) AS has_lines FROM documents GROUP BY lang")
def txt_31(spark, d):
    rate = lambda c: F.avg(F.when(c, 100.0).otherwise(0.0))
    return docs(spark, d).groupBy("lang").agg(rate(F.col("report").rlike(r"(?i)\bthe\b")).alias("has_the"), rate(F.col("report").contains("\n")).alias("has_lines"))


@register("txt_33_document_frequency", f"WITH t AS (SELECT lang, unnest(list_distinct({TOKENS_SQL})) AS word FROM documents) SELECT lang, word, count(*) AS n_docs FROM t WHERE length(word) >= 4 AND word NOT IN ('that', 'this') GROUP BY lang, word")
def txt_33(spark, d):
    return P.document_frequency(docs(spark, d), "report", ["lang"], 4, ("that", "this"))


@register(
    "agg_14_text_lengths",
    rf"""WITH m AS (SELECT lang, unnest(['characters', 'words']) AS measure, unnest([CAST(length(text) AS DOUBLE), CAST(len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS DOUBLE)]) AS v FROM documents)
    SELECT lang, measure, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, median(v) AS median, min(v) AS min, max(v) AS max, round(quantile_cont(v, 0.05), 6) AS p05, round(quantile_cont(v, 0.25), 6) AS p25,
      round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.95), 6) AS p95, round(quantile_cont(v, 0.99), 6) AS p99 FROM m GROUP BY lang, measure""",
)
def agg_14(spark, d):
    found = P.lengths(docs(spark, d), ["lang"], "report")
    return found.select("lang", "measure", "n", "median", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", *R.PERCENTS)])


@register("agg_21_duplicate_groups", f"WITH n AS (SELECT doc_id, sha256({NORM_SQL}) AS h FROM documents) SELECT h AS family, count(*) AS n, min(doc_id) AS first_key FROM n GROUP BY h HAVING count(*) > 1")
def agg_21(spark, d):
    return P.duplicate_groups(docs(spark, d).withColumn("family", X.sha256(norm())), "study", "family")


@register("agg_21_duplicate_summary", "WITH s AS (SELECT text, count(*) AS n FROM documents GROUP BY text) SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS excess, count(*) FILTER (n > 1) AS n_groups, max(n) AS largest FROM s")
def agg_21b(spark, d):
    return P.duplicate_summary(docs(spark, d), "report")


@register(
    "agg_05_family_consistency",
    f"WITH f AS (SELECT sha256('exact:' || {NORM_SQL}) AS exact_family, source, lang FROM documents) SELECT exact_family, source, count(*) AS n, count(DISTINCT coalesce(lang, 'null')) AS n_values FROM f GROUP BY ALL HAVING count(*) > 1",
)
def agg_05(spark, d):
    return P.inconsistent_families(P.families(docs(spark, d), "report"), "exact_family", "source", "lang")


@register(
    "agg_23_lexical_diversity",
    f"""WITH t AS (SELECT unnest({TOKENS_SQL}) AS gram FROM documents), c AS (SELECT gram, count(*) AS n FROM t GROUP BY gram), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, gram) AS r FROM c)
    SELECT count(*) AS types, CAST(sum(n) AS BIGINT) AS tokens, count(*) / sum(n) AS type_token_ratio, sum(n) FILTER (r <= 10) / sum(n) AS top10_share, sum(n) FILTER (r <= 25) / sum(n) AS top25_share,
      sum(n) FILTER (r <= 50) / sum(n) AS top50_share, sum(n) FILTER (r <= 100) / sum(n) AS top100_share FROM r""",
)
def agg_23(spark, d):
    return P.diversity(P.gram_counts(docs(spark, d), "report", 1))


@register(
    "agg_56_log_lift",
    f"""WITH t AS (SELECT doc_id, lang = 'en' AS en, unnest(list_distinct({TOKENS_SQL})) AS word FROM documents), n AS (SELECT count(*) FILTER (lang = 'en') AS a, count(*) FILTER (lang <> 'en') AS b FROM documents),
    c AS (SELECT word, count(*) FILTER (en) AS c_en, count(*) FILTER (NOT en) AS c_other FROM t GROUP BY word) SELECT word, c_en, c_other, round(log2(((c_en + 1) / (a + 2)) / ((c_other + 1) / (b + 2))), 9) AS lift FROM c, n WHERE c_en + c_other >= 5""",
)
def agg_56(spark, d):
    from reportmill.operators.metrics import log_lift

    texts = docs(spark, d)
    found = texts.select((F.col("lang") == "en").alias("en"), F.explode(F.array_distinct(words())).alias("word"))
    c = found.groupBy("word").agg(F.count_if("en").alias("c_en"), F.count_if(~F.col("en")).alias("c_other")).where("c_en + c_other >= 5")
    n = texts.agg(F.count_if(F.col("lang") == "en").alias("a"), F.count_if(F.col("lang") != "en").alias("b"))
    out = log_lift(c.join(F.broadcast(n)), F.col("c_en"), F.col("a"), F.col("c_other"), F.col("b"))
    return out.select("word", "c_en", "c_other", F.round("lift", 9).alias("lift"))


@register("agg_35_stratified_sample", """WITH h AS (SELECT doc_id AS study, lang, source, sha256('11:' || CAST(doc_id AS VARCHAR)) AS h FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY h) AS k FROM h)
    SELECT study, lang, source FROM r WHERE k <= 1 ORDER BY h LIMIT 60""")
def agg_35(spark, d):
    return R.stratified_sample(docs(spark, d), ["lang", "source"], "study", 11, 1, 60).select("study", "lang", "source")


@register("srt_04_hash_limit", "SELECT doc_id AS study FROM documents ORDER BY sha256('5:' || CAST(doc_id AS VARCHAR)) LIMIT 600")
def srt_04(spark, d):
    return R.hash_sample(docs(spark, d), "study", 5, 600).select("study")


@register("win_03_group_size", "SELECT doc_id AS study, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def win_03(spark, d):
    rows = docs(spark, d).select("study", F.coalesce(X.sha256(F.col("report")), F.lit("")).alias("copy"))  # null texts are one group, and no text is dealt
    return rows.join(rows.groupBy("copy").agg(F.count(F.lit(1)).alias("copies")), "copy").select("study", "copies")


@register("win_06_first_per_group", "SELECT source, lang, min(doc_id) AS study FROM documents GROUP BY source, lang")
def win_06(spark, d):
    return R.first_per_group(docs(spark, d), ["source", "lang"], F.col("study")).select("source", "lang", "study")


@register("jon_20_adjacent_turns", "SELECT conv_id, turn, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role FROM conversations")
def jon_20(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", F.lead("role").over(Window.partitionBy("conv_id").orderBy("turn")).alias("next_role"))


@register("set_05_ordered_distinct", "WITH r AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role) SELECT conv_id, string_agg(role, '>' ORDER BY t) AS roles FROM r GROUP BY conv_id")
def set_05(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("x"))
    return rows.select("conv_id", F.array_join(F.array_distinct("x.role"), ">").alias("roles"))
