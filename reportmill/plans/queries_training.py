"""Registered queries: joins, windows, sets, statistics, training sets and splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reportmill.functions import text as X
from reportmill.functions import vocabulary as V
from reportmill.operators import labelling as L
from reportmill.operators import profile as P
from reportmill.operators import relational as R
from reportmill.operators import training as T
from reportmill.plans.corpora import docs, reports
from reportmill.plans.gold import TARGETS_SQL
from reportmill.plans.queries_labels import TRUSTED_SQL, WITH
from reportmill.plans.registry import register
from reportmill.plans.shipping import ship
from reportmill.sources.tables import table


def count():
    return F.count(F.lit(1))



def _t(name):
    return lambda spark, d: table(spark, d, name)


orders, lineitem, customer, nation, events, labels, documents, supplier, part = map(_t, ("orders", "lineitem", "customer", "nation", "events", "labels", "documents", "supplier", "part"))

# --- joins


@register("jon_01_unique_inner_join", "SELECT l.doc_id, d.lang AS lang_left, l.quality AS quality_right FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def jon_01(spark, d):
    return documents(spark, d).select("doc_id", F.col("lang").alias("lang_left")).join(labels(spark, d).select("doc_id", F.col("quality").alias("quality_right")), "doc_id")


@register("jon_02_changed_pairs", "SELECT doc_id, quality, toxic FROM labels WHERE quality <> toxic")
def jon_02(spark, d):
    a, b = labels(spark, d).select("doc_id", "quality"), labels(spark, d).select("doc_id", "toxic")
    return a.join(b, "doc_id").where("quality != toxic").orderBy("doc_id")


@register("jon_03_many_to_one", "SELECT o_orderkey, c_custkey, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def jon_03(spark, d):
    c = customer(spark, d).select("c_custkey", "c_nationkey")
    return orders(spark, d).join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_custkey", "c_nationkey")


@register("jon_05_pivot_join", "WITH p AS (SELECT doc_id, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM labels GROUP BY doc_id) SELECT lang, CAST(sum(coalesce(good, 0)) AS BIGINT) AS good, CAST(sum(coalesce(bad, 0)) AS BIGINT) AS bad FROM documents LEFT JOIN p USING (doc_id) GROUP BY lang")
def jon_05(spark, d):
    p = labels(spark, d).groupBy("doc_id").agg(F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"))
    joined = documents(spark, d).select("doc_id", "lang").join(p, "doc_id", "left").na.fill(0, ["good", "bad"])
    return joined.groupBy("lang").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


@register("jon_06_one_to_many", "WITH g AS (SELECT text FROM documents GROUP BY text HAVING count(*) > 1) SELECT doc_id, lang, quality FROM documents JOIN g USING (text) LEFT JOIN labels USING (doc_id)")
def jon_06(spark, d):
    g = P.duplicate_groups(documents(spark, d), "doc_id", "text").select("text")
    return documents(spark, d).join(g, "text").join(labels(spark, d).select("doc_id", "quality"), "doc_id", "left").select("doc_id", "lang", "quality")


@register("jon_07_counts_with_zero", "SELECT c_custkey, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def jon_07(spark, d):
    n = orders(spark, d).groupBy(F.col("o_custkey").alias("c_custkey")).agg(count().alias("n_orders"))
    return customer(spark, d).select("c_custkey").join(n, "c_custkey", "left").na.fill(0)


@register("jon_08_chained_left_joins", """SELECT doc_id, coalesce(l.n, 0) AS n_labels, coalesce(c.n, 0) AS n_turns FROM documents LEFT JOIN (SELECT doc_id, count(*) AS n FROM labels GROUP BY 1) l USING (doc_id)
    LEFT JOIN (SELECT conv_id AS doc_id, count(*) AS n FROM conversations GROUP BY 1) c USING (doc_id)""")
def jon_08(spark, d):
    a = labels(spark, d).groupBy("doc_id").agg(count().alias("n_labels"))
    b = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(count().alias("n_turns"))
    return documents(spark, d).select("doc_id").join(a, "doc_id", "left").join(b, "doc_id", "left").na.fill(0)


@register("jon_09_two_inner_joins", "SELECT o_orderkey, l_linenumber, c_nationkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_quantity > 45")
def jon_09(spark, d):
    li = lineitem(spark, d).where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber")
    c = customer(spark, d).select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return orders(spark, d).select("o_orderkey", "o_custkey").join(li, "o_orderkey").join(c, "o_custkey").select("o_orderkey", "l_linenumber", "c_nationkey")


@register("jon_10_reference_joins", "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def jon_10(spark, d):
    return supplier(spark, d).join(nation(spark, d), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


@register("jon_11_inference_grid", f"WITH {TARGETS_SQL} SELECT doc_id AS study, target FROM documents CROSS JOIN targets")
def jon_11(spark, d):
    return L.grid(docs(spark, d).select("study"))


@register("jon_13_semi_join", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def jon_13(spark, d):
    return documents(spark, d).select("doc_id", "lang").join(labels(spark, d).where("quality = 1"), "doc_id", "left_semi")


@register("jon_14_composite_semi_join", "SELECT lang, source, doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM documents e WHERE e.lang = d.lang AND e.source = d.source AND e.n_chars > 8000)")
def jon_14(spark, d):
    long = documents(spark, d).where("n_chars > 8000").select("lang", "source")
    return documents(spark, d).select("lang", "source", "doc_id").join(long, ["lang", "source"], "left_semi")


@register("jon_15_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def jon_15(spark, d):
    return customer(spark, d).select("c_custkey").join(orders(spark, d).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@register("jon_16_rest_after_heads", "WITH h AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY source, lang) SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM h)")
def jon_16(spark, d):
    heads = R.first_per_group(documents(spark, d), ["source", "lang"], F.col("doc_id")).select("doc_id")
    return documents(spark, d).select("doc_id").join(heads, "doc_id", "left_anti")


_NOVEL = "WITH tr AS (SELECT text, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY text), te AS (SELECT doc_id, text FROM documents WHERE doc_id % 3 = 0)"


@register("jon_17_novelty", _NOVEL + " SELECT doc_id, coalesce(n, 0) AS train_matches, n IS NULL AS is_novel FROM te LEFT JOIN tr USING (text)")
def jon_17(spark, d):
    rows = documents(spark, d).select("doc_id", "text")
    return T.novelty(rows.where("doc_id % 3 = 0"), rows.where("doc_id % 3 != 0"), ["text"]).select("doc_id", "train_matches", "is_novel")


@register("jon_18_dictionary_lookup", "SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' WHEN 'fr' THEN 'french' WHEN 'es' THEN 'spanish' END AS language FROM documents")
def jon_18(spark, d):
    names = F.create_map(*[F.lit(x) for kv in {"en": "english", "de": "german", "fr": "french", "es": "spanish"}.items() for x in kv])
    return documents(spark, d).select("doc_id", F.element_at(names, F.col("lang")).alias("language"))


@register("jon_21_triangular_sample", "WITH f AS (SELECT doc_id FROM documents ORDER BY sha256('3:' || CAST(doc_id AS VARCHAR)) LIMIT 30) SELECT a.doc_id AS a, b.doc_id AS b FROM f a JOIN f b ON a.doc_id < b.doc_id")
def jon_21(spark, d):
    few = R.hash_sample(documents(spark, d).select("doc_id"), "doc_id", 3, 30).select("doc_id")
    return few.select(F.col("doc_id").alias("a")).join(few.select(F.col("doc_id").alias("b")), F.col("a") < F.col("b"))


@register("jon_23_subset_check", "SELECT count(*) AS missing FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def jon_23(spark, d):
    return labels(spark, d).join(documents(spark, d).select("doc_id"), "doc_id", "left_anti").agg(count().alias("missing"))


# --- aggregates


@register("agg_07_language_summary", """SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, avg(n_chars) AS mean_chars, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad,
    count(*) FILTER (quality IS NOT NULL) / count(*) AS labelled_rate FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang""")
def agg_07(spark, d):
    rows = documents(spark, d).select("doc_id", "lang", "n_chars").join(labels(spark, d).select("doc_id", "quality"), "doc_id", "left")
    return rows.groupBy("lang").agg(
        count().alias("n"), F.sum("n_chars").alias("chars"), F.avg("n_chars").alias("mean_chars"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad"),
        (F.count("quality") / count()).alias("labelled_rate"),
    )


_DESCRIBE = "count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, median(v) AS median, min(v) AS min, max(v) AS max, " + ", ".join(f"round(quantile_cont(v, {p}), 6) AS {n}" for n, p in R.PERCENTS.items())


@register("agg_11_describe", f"SELECT source, {_DESCRIBE} FROM (SELECT source, CAST(n_chars AS DOUBLE) AS v FROM documents) GROUP BY source")
def agg_11(spark, d):
    found = R.describe(documents(spark, d).withColumn("v", F.col("n_chars").cast("double")), ["source"], "v")
    return found.select("source", "n", "median", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "std", *R.PERCENTS)])


@register("agg_12_population", "SELECT event_type, count(value) AS n, round(var_pop(value), 4) AS variance, round(stddev_pop(value), 6) AS sd, " + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in (25, 50, 75, 90, 95, 99)) + " FROM events GROUP BY event_type")
def agg_12(spark, d):
    found = R.population(events(spark, d), ["event_type"], "value")
    return found.select("event_type", "n", F.round("variance", 4).alias("variance"), F.round("sd", 6).alias("sd"), *[F.round(f"p{p}", 6).alias(f"p{p}") for p in (25, 50, 75, 90, 95, 99)])


@register("agg_19_share_in_group", "SELECT l_returnflag, l_linestatus, n, n / sum(n) OVER (PARTITION BY l_returnflag) AS share FROM (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)")
def agg_19(spark, d):
    return R.shares(lineitem(spark, d).groupBy("l_returnflag", "l_linestatus").agg(count().alias("n")), ["l_returnflag"])


@register("agg_20_cumulative_share", "SELECT source, n, n / sum(n) OVER () AS share, sum(n) OVER (ORDER BY n DESC, source ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS cumulative_share FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def agg_20(spark, d):
    return R.cumulative_share(documents(spark, d).groupBy("source").agg(count().alias("n")), "n", [F.desc("n"), F.col("source")])


@register("agg_28_first_example", "SELECT lang, source, count(*) AS n, min(doc_id) AS first_doc, arg_min(n_chars, doc_id) AS first_chars FROM documents GROUP BY lang, source")
def agg_28(spark, d):
    return documents(spark, d).groupBy("lang", "source").agg(count().alias("n"), F.min("doc_id").alias("first_doc"), F.min_by("n_chars", "doc_id").alias("first_chars"))


@register("agg_47_null_profile", "SELECT unnest(['doc_id', 'lang', 'source', 'n_chars']) AS \"column\", count(*) AS n_rows, CAST(0 AS BIGINT) AS n_null, unnest([count(DISTINCT doc_id), count(DISTINCT lang), count(DISTINCT source), count(DISTINCT n_chars)]) AS n_distinct FROM documents")
def agg_47(spark, d):
    return R.null_profile(documents(spark, d).select("doc_id", "lang", "source", "n_chars"))


@register("agg_48_crosstab", "SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def agg_48(spark, d):
    return R.pivot_counts(orders(spark, d), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@register("agg_49_row_aggregates", "SELECT doc_id AS study, doc_id % 20 = 0 AS any_label, CASE WHEN doc_id % 20 = 0 THEN CAST(6 AS DOUBLE) END AS label_sum FROM documents")
def agg_49(spark, d):
    known = F.filter(F.array(*[F.col(f"`{t}`") for t in V.TARGETS]), lambda x: x.isNotNull())
    total = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x))
    return reports(spark, d).select("study", (F.size(known) > 0).alias("any_label"), total.alias("label_sum"))


@register("agg_50_top_values", "WITH c AS (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, source) AS rank FROM c) SELECT lang, source, n, rank FROM r WHERE rank <= 10")
def agg_50(spark, d):
    return R.top_per_group(documents(spark, d).groupBy("lang", "source").agg(count().alias("n")), ["lang"], [F.desc("n"), F.col("source")], 10)


@register("agg_51_hierarchical_counts", "WITH o AS (SELECT l_orderkey, count(*) AS lines FROM lineitem GROUP BY 1) SELECT o_custkey, count(*) AS n_orders, CAST(sum(lines) AS BIGINT) AS n_lines, max(lines) AS most_lines FROM orders JOIN o ON l_orderkey = o_orderkey GROUP BY o_custkey")
def agg_51(spark, d):
    lines = lineitem(spark, d).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(count().alias("lines"))
    rows = orders(spark, d).select("o_orderkey", "o_custkey").join(lines, "o_orderkey")
    return rows.groupBy("o_custkey").agg(count().alias("n_orders"), F.sum("lines").alias("n_lines"), F.max("lines").alias("most_lines"))


@register("agg_52_overlap", "SELECT count(*) AS n_docs, count(l.doc_id) AS labelled, count(l.doc_id) / count(*) AS rate FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def agg_52(spark, d):
    known = labels(spark, d).select("doc_id").distinct().withColumn("hit", F.lit(1))
    return documents(spark, d).select("doc_id").join(known, "doc_id", "left").agg(count().alias("n_docs"), F.count("hit").alias("labelled"), (F.count("hit") / count()).alias("rate"))


@register("agg_54_sampling_weights", "WITH c AS (SELECT source, 1 / sqrt(count(*)) AS w FROM documents GROUP BY source), m AS (SELECT min(w) AS least FROM c) SELECT doc_id, round(least(w, least * 1.5), 12) AS weight FROM documents JOIN c USING (source), m")
def agg_54(spark, d):
    return R.capped_weights(documents(spark, d).select("doc_id", "source"), ["source"], 1.5).select("doc_id", F.round("weight", 12).alias("weight"))


@register("agg_57_cumulative_distribution", "SELECT doc_id, cume_dist() OVER (PARTITION BY lang, source ORDER BY n_chars) AS ecdf FROM documents")
def agg_57(spark, d):
    return documents(spark, d).select("doc_id", F.cume_dist().over(Window.partitionBy("lang", "source").orderBy("n_chars")).alias("ecdf"))


@register("snk_09_histogram", "WITH q AS (SELECT quantile_cont(n_chars, 0.99) AS top FROM documents) SELECT CAST(least(9, floor(n_chars / (top / 10))) AS BIGINT) AS bin, count(*) AS n FROM documents, q WHERE n_chars <= top GROUP BY 1")
def snk_09(spark, d):
    top = documents(spark, d).agg(F.percentile("n_chars", F.lit(0.99)).alias("top"))
    rows = documents(spark, d).select("n_chars").join(F.broadcast(top)).where("n_chars <= top")
    return rows.groupBy(F.least(F.lit(9), F.floor(F.col("n_chars") / (F.col("top") / 10))).cast("long").alias("bin")).agg(count().alias("n"))


@register("snk_14_split_counts", "SELECT doc_id % 3 AS split, lang, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def snk_14(spark, d):
    rows = documents(spark, d).select("doc_id", "lang").join(labels(spark, d), "doc_id")
    return rows.groupBy((F.col("doc_id") % 3).alias("split"), "lang", "quality").agg(count().alias("n"))


# --- windows, sorts, sets


@register("win_04_running_share", "SELECT n_name, n, sum(n) OVER (ORDER BY n DESC, n_name ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS running FROM (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)")
def win_04(spark, d):
    counts = customer(spark, d).join(nation(spark, d), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(count().alias("n"))
    return R.cumulative_share(counts, "n", [F.desc("n"), F.col("n_name")]).select("n_name", "n", F.col("cumulative_share").alias("running"))


@register("win_01_carry_forward", """WITH e AS (SELECT *, CASE WHEN event_type = 'purchase' THEN event_id END AS mark FROM events) SELECT event_id, last_value(mark IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM e""")
def win_01(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return events(spark, d).select("event_id", F.last(F.when(F.col("event_type") == "purchase", F.col("event_id")), ignorenulls=True).over(w).alias("last_purchase"))


@register("win_07_heads_then_rest", "WITH r AS (SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) = 1 AS is_head FROM documents) SELECT doc_id, is_head FROM r ORDER BY is_head DESC, doc_id LIMIT 100")
def win_07(spark, d):
    return R.heads_then_rest(documents(spark, d).select("doc_id", "source"), ["source"], [F.col("doc_id")], 100).select("doc_id", "is_head")


@register("srt_01_mixed_sort", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate, o_totalprice DESC, o_orderkey")
def srt_01(spark, d):
    return orders(spark, d).select("o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_totalprice").orderBy("o_orderdate", F.desc("o_totalprice"), "o_orderkey")


@register("srt_02_category_order", f"WITH {TARGETS_SQL} SELECT ord, target FROM targets ORDER BY ord")
def srt_02(spark, d):
    return L.target_table(spark).orderBy("ord")


@register("srt_03_top_k", "SELECT p_type, count(*) AS n FROM part GROUP BY p_type ORDER BY n DESC, p_type LIMIT 20")
def srt_03(spark, d):
    return part(spark, d).groupBy("p_type").agg(count().alias("n")).orderBy(F.desc("n"), "p_type").limit(20)


@register("set_01_ragged_union", "SELECT doc_id, lang, NULL::INT AS quality FROM documents UNION ALL SELECT doc_id, NULL AS lang, quality FROM labels")
def set_01(spark, d):
    return documents(spark, d).select("doc_id", "lang").unionByName(labels(spark, d).select("doc_id", "quality"), allowMissingColumns=True)


@register("set_02_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_02(spark, d):
    return documents(spark, d).select("doc_id").subtract(labels(spark, d).select("doc_id"))


@register("set_03_intersection", "SELECT count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)")
def set_03(spark, d):
    return documents(spark, d).select("doc_id").intersect(labels(spark, d).select("doc_id")).agg(count().alias("n"))


@register("set_04_distinct_pairs", "SELECT count(*) AS n FROM (SELECT DISTINCT lang, source FROM documents)")
def set_04(spark, d):
    return documents(spark, d).agg(F.count_distinct("lang", "source").alias("n"))


@register("set_06_frame_equality", "SELECT CAST(0 AS BIGINT) AS only_left, CAST(0 AS BIGINT) AS only_right")
def set_06(spark, d):
    return R.same_rows(documents(spark, d), documents(spark, d).orderBy("lang"))


# --- training sets


@register("dst_06_training_dedup", "WITH k AS (SELECT source, text FROM documents GROUP BY source, text HAVING count(DISTINCT lang) = 1) SELECT min(doc_id) AS doc_id, source, count(*) AS n_rows FROM documents JOIN k USING (source, text) GROUP BY source, text")
def dst_06(spark, d):
    clean, _ = T.training_dedup(documents(spark, d).select("doc_id", "source", "text", "lang"), "source", "text", "lang", "doc_id")
    return clean.select("doc_id", "source", "n_rows")


@register("dst_01_template_families", WITH + r", n AS (SELECT study, trim(regexp_replace(regexp_replace(strip_accents(lower(translate(report, 'ı', 'i'))), '[ \t]+', ' ', 'g'), '-', ' ', 'g')) AS t FROM docs_t) SELECT study, sha256('exact:' || t) AS exact_family, sha256('numeric:' || regexp_replace(t, '\b[0-9]+([.,][0-9]+)*\b', '<num>', 'g')) AS numeric_family FROM n")
def dst_01(spark, d):
    return P.families(reports(spark, d), "report").select("study", "exact_family", "numeric_family")


def _usable(spark, d):
    rows = reports(ship(spark), d)
    made = L.supervision(rows).select("study", "target", "rationale", "official_label", F.explode("evidence_provenance").alias("p")).select("study", "target", "rationale", "official_label", "p.*")
    return T.candidates(made, T.surface_clauses(rows)).where("failure IS NULL")


@register("dst_05_contrastive_negatives", None)
def dst_05(spark, d):
    safe = T.safe_targets(_usable(spark, d), T.guard_keys(L.mentions(reports(spark, d))))
    return T.contrastive(safe, 17)


@register("prj_14_model_input", WITH + f", {TRUSTED_SQL} SELECT target, raw FROM trusted t JOIN clause c ON c.tid = t.tid AND c.idx = t.source_indices[1] WHERE diagnostic AND raw IS NOT NULL")
def prj_14(spark, d):
    return _usable(spark, d).select("target", "raw")


@register("jon_04_one_to_one", "SELECT d.doc_id, lang, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def jon_04(spark, d):
    return documents(spark, d).select("doc_id", "lang").join(labels(spark, d).select("doc_id", "quality"), "doc_id", "left")


@register("txt_14_alignment", WITH + "SELECT study, idx, raw, c.text AS expected, diagnostic, CASE WHEN raw IS NULL THEN 'no_exact_span' END AS reason FROM docs_t JOIN clause c USING (tid)")
def txt_14(spark, d):
    return T.surface_clauses(reports(ship(spark), d)).select("study", "idx", "raw", "expected", "diagnostic", "reason")


@register("dst_02_trusted_candidates", WITH + f", {TRUSTED_SQL} SELECT study, target, status, idx, raw, CASE WHEN NOT diagnostic THEN 'non_diagnostic_clause' WHEN raw IS NULL THEN 'no_exact_span' END AS failure FROM trusted t JOIN clause c ON c.tid = t.tid AND c.idx = t.source_indices[1]")
def dst_02(spark, d):
    rows = reports(ship(spark), d)
    made = L.supervision(rows).select("study", "target", "rationale", "official_label", F.explode("evidence_provenance").alias("p")).select("study", "target", "rationale", "official_label", "p.*")
    return T.candidates(made, T.surface_clauses(rows)).select("study", "target", "status", "idx", "raw", "failure")


_GROUPED = "WITH f AS (SELECT doc_id AS study, sha256(text) AS family, lang, count(*) OVER (PARTITION BY text) AS k FROM documents), g AS (SELECT *, CASE WHEN k > 1 THEN 'template:' || family ELSE 'study:' || CAST(study AS VARCHAR) END AS split_group FROM f)"


def _grouped(spark, d):
    return docs(spark, d).select("study", X.sha256(F.col("report")).alias("family"), "lang", "source")


@register("spl_01_split_groups", _GROUPED + " SELECT study, split_group FROM g")
def spl_01(spark, d):
    return T.split_groups(_grouped(spark, d), "study", "family").select("study", "split_group")


@register("agg_46_group_features", _GROUPED + " SELECT split_group, unnest(['__studies__', 'lang=' || lang]) AS feature, 1 AS one FROM g".replace("SELECT split_group, unnest(['__studies__', 'lang=' || lang]) AS feature, 1 AS one FROM g", "SELECT split_group, feature, count(*) AS n FROM (SELECT split_group, unnest(['__studies__', 'lang=' || lang]) AS feature FROM g) GROUP BY ALL"))
def agg_46(spark, d):
    return T.group_features(T.split_groups(_grouped(spark, d), "study", "family"), ["lang"])


@register("spl_02_rarity", _GROUPED + """, c AS (SELECT split_group, lang, count(*) AS n FROM g GROUP BY ALL), t AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang)
    SELECT split_group, round(sum(n / total), 12) AS rarity, CAST(sum(n) AS BIGINT) AS studies FROM c JOIN t USING (lang) GROUP BY split_group""")
def spl_02(spark, d):
    counts = T.group_features(T.split_groups(_grouped(spark, d), "study", "family"), ["lang"])
    return T.rarity_order(counts, 1).select("split_group", F.round("rarity", 12).alias("rarity"), "studies")


@register("spl_05_assignment", None)
def spl_05(spark, d):
    return T.assign_splits(_grouped(spark, d), "study", "family", ["lang", "source"]).select("study", "split_group", "split")


@register("agg_45_leak_audit", "SELECT unnest(['split_group', 'family']) AS \"check\", CAST(0 AS BIGINT) AS violations")
def agg_45(spark, d):
    return T.leaks(T.assign_splits(_grouped(spark, d), "study", "family", ["lang"]), ["split_group", "family"])


@register("ml_04_truncation", r"SELECT lang, count(*) FILTER (len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) > 512) AS n_truncated, CAST(max(len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))) AS INT) AS most_tokens FROM documents GROUP BY lang")
def ml_04(spark, d):
    n = F.size(X.tokens(F.col("report")))
    return docs(spark, d).groupBy("lang").agg(F.count_if(n > 512).alias("n_truncated"), F.max(n).alias("most_tokens"))


@register("ml_05_softmax", "SELECT l_orderkey, l_linenumber, round(exp(l_discount) / (exp(l_discount) + exp(l_tax)), 9) AS p FROM lineitem")
def ml_05(spark, d):
    p = F.get(T.softmax(F.array(F.col("l_discount").cast("double"), F.col("l_tax").cast("double"))), F.lit(0))
    return lineitem(spark, d).select("l_orderkey", "l_linenumber", F.round(p, 9).alias("p"))


@register("prj_09_cases", "SELECT doc_id, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'medium' ELSE 'long' END AS size_class, lang IN ('en', 'de') AS germanic, contains(text, '|') AS has_bar FROM documents")
def prj_09(spark, d):
    n = F.col("n_chars")
    size = F.when(n < 500, "short").when(n < 3000, "medium").otherwise("long")
    return documents(spark, d).select("doc_id", size.alias("size_class"), F.col("lang").isin("en", "de").alias("germanic"), F.col("text").contains("|").alias("has_bar"))


@register("txt_29_json_lists", "SELECT source, CAST(to_json(list_sort(list(DISTINCT lang))) AS VARCHAR) AS langs FROM documents GROUP BY source")
def txt_29(spark, d):
    return documents(spark, d).groupBy("source").agg(F.to_json(F.array_sort(F.collect_set("lang"))).alias("langs"))
