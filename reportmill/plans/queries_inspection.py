"""Registered queries: inspection of the labelled reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from reportmill.functions import text as X
from reportmill.functions import vocabulary as V
from reportmill.operators import inspection as I
from reportmill.operators import labelling as L
from reportmill.operators import metrics as M
from reportmill.operators import profile as P
from reportmill.operators import relational as R
from reportmill.operators import training as T
from reportmill.plans.corpora import docs, reports
from reportmill.plans.queries_labels import WITH
from reportmill.plans.registry import register
from reportmill.plans.shipping import ship
from reportmill.sources.tables import header_value, table


def _rows(spark, d):
    return L.supervision(reports(ship(spark), d))


def _inventory(spark, d):
    return I.evidence(_rows(spark, d))


_ROUNDED = {c: 6 for c in ("mean", "std", "median", "min", "max", *R.PERCENTS)}
_DESCRIBED = ", ".join(
    ["count(v) AS n", "round(avg(v), 6) AS mean", "round(stddev_samp(v), 6) AS std", "round(quantile_cont(v, 0.5), 6) AS median", "round(min(v), 6) AS min", "round(max(v), 6) AS max"]
    + [f"round(quantile_cont(v, {p}), 6) AS {n}" for n, p in R.PERCENTS.items()]
)


def _described(df, *keys):
    return df.select(*keys, "n", *[F.round(c, k).alias(c) for c, k in _ROUNDED.items()])


@register("agg_34_evidence_per_pair", WITH + "SELECT DISTINCT study, target, status, winning FROM inventory")
def agg_34(spark, d):
    return _inventory(spark, d).select("study", "target", "status", "winning").distinct()


@register(
    "agg_17_detector_tables",
    WITH + """, x AS (SELECT study, target, status, unnest(detectors) AS detector FROM inventory)
    SELECT detector, status, target, CASE grouping(status, target) WHEN 3 THEN 'detector' WHEN 1 THEN 'detector+status' ELSE 'detector+status+target' END AS level,
      count(*) AS n, count(DISTINCT study) AS n_studies, count(DISTINCT study || target) AS n_pairs
    FROM x GROUP BY GROUPING SETS ((detector), (detector, status), (detector, status, target))""",
)
def agg_17(spark, d):
    return I.detector_counts(_inventory(spark, d))


@register(
    "agg_18_confidence",
    WITH + f""", x AS (SELECT confidence AS v, unnest(['status', 'target', 'language', 'detectors', 'support']) AS dimension, unnest([status, target, language_group, detector_combination, view_support]) AS value FROM inventory)
    SELECT dimension, value, {_DESCRIBED} FROM x GROUP BY dimension, value""",
)
def agg_18(spark, d):
    return _described(I.confidence_by_dimension(_inventory(spark, d)), "dimension", "value")


@register("agg_19_phenotypes", WITH + "SELECT target, status, phenotype, count(*) AS n, count(DISTINCT study) AS n_studies, count(*) / sum(count(*)) OVER (PARTITION BY target, status) AS share FROM inventory GROUP BY target, status, phenotype")
def agg_19(spark, d):
    return I.phenotype_shares(_inventory(spark, d))


@register(
    "agg_20_rules",
    WITH + """, x AS (SELECT unnest(CASE WHEN len(rules) = 0 THEN ['<no_explicit_rule>'] ELSE rules END) AS rule FROM inventory), c AS (SELECT rule, count(*) AS n FROM x GROUP BY rule)
    SELECT rule, n, n / sum(n) OVER () AS share, sum(n) OVER (ORDER BY n DESC, rule ROWS UNBOUNDED PRECEDING) / sum(n) OVER () AS cumulative_share FROM c""",
)
def agg_20(spark, d):
    return I.rule_shares(_inventory(spark, d))


@register(
    "agg_25_conflicts",
    WITH + """SELECT study, target, any_value(r.status) AS status, round(any_value(greatest(0.4, top - 0.18)), 6) AS confidence, array_to_string(list_sort(list(DISTINCT i.status)), '+') AS statuses,
      array_to_string(list_sort(list(DISTINCT detector_combination)), '|') AS detector_combinations FROM inventory i JOIN resolved r USING (tid, target) WHERE r.conflict GROUP BY study, target""",
)
def agg_25(spark, d):
    found = I.conflicts(_rows(spark, d), _inventory(spark, d))
    return found.select("study", "target", "status", "confidence", F.array_join("statuses", "+").alias("statuses"), F.array_join("detector_combinations", "|").alias("detector_combinations"))


@register(
    "agg_26_collective_support",
    WITH + """SELECT 'mention' AS unit, target, status, rule, count(*) AS n, count(DISTINCT study) AS n_studies FROM mention JOIN docs_t USING (tid) WHERE collective GROUP BY ALL
    UNION ALL SELECT 'proposition', target, status, rule, count(*), count(DISTINCT study) FROM (SELECT study, target, status, unnest(rules) AS rule FROM prop JOIN docs_t USING (tid) WHERE collective) GROUP BY ALL""",
)
def agg_26(spark, d):
    found = L.mentions(reports(ship(spark), d))
    return I.collective_support(found, L.propositions(found))


@register("agg_27_view_support", WITH + "SELECT target, status, view_support, count(*) AS n, count(DISTINCT study) AS n_studies FROM inventory GROUP BY ALL")
def agg_27(spark, d):
    return I.view_support(_inventory(spark, d))


_NEGATION = r"""CASE WHEN has_span AND regexp_matches(evidence, 'saptanmamistir|aucune') THEN 'postposed' WHEN has_span AND regexp_matches(evidence, '\b(no|pas de)\b') THEN 'preposed'
    WHEN regexp_matches(evidence, 'intact|normal|preserved') THEN 'explicit_normality' ELSE 'other_implemented_negation' END"""


@register("agg_28_negations", WITH + f"SELECT target, {_NEGATION} AS negation, count(*) AS n, count(DISTINCT study) AS n_studies FROM inventory WHERE status = 'negative' GROUP BY ALL")
def agg_28(spark, d):
    return I.negations(_inventory(spark, d)).drop("first_example")


@register("txt_25_negation_types", WITH + f"SELECT DISTINCT evidence, phenotype, {_NEGATION} AS negation FROM inventory WHERE status = 'negative'")
def txt_25(spark, d):
    return _inventory(spark, d).where("status = 'negative'").select("evidence", "phenotype", I.negation_type(F.col("evidence"), F.col("spans")).alias("negation")).distinct()


@register("agg_29_uncertainties", WITH + "SELECT target, regexp_extract(evidence, 'possibl[ey]') AS marker, count(*) AS n, count(DISTINCT study) AS n_studies FROM inventory WHERE status = 'uncertain' GROUP BY ALL")
def agg_29(spark, d):
    return I.uncertainties(_inventory(spark, d))


@register(
    "agg_31_clause_usage",
    WITH + """, used AS (SELECT DISTINCT tid, unnest(source_indices) AS idx FROM chosen), said AS (SELECT DISTINCT tid, unnest(sources) AS idx FROM mention)
    SELECT CASE WHEN u.idx IS NOT NULL THEN 'selected' WHEN s.idx IS NOT NULL THEN 'mentioned' ELSE 'silent' END AS usage, diagnostic, count(*) AS n, count(DISTINCT study) AS n_studies
    FROM clause c JOIN docs_t USING (tid) LEFT JOIN used u ON u.tid = c.tid AND u.idx = c.idx LEFT JOIN said s ON s.tid = c.tid AND s.idx = c.idx GROUP BY ALL""",
)
def agg_31(spark, d):
    docs_ = reports(ship(spark), d)
    return I.clause_usage(L.clauses(docs_), L.mentions(docs_), _inventory(spark, d))


@register(
    "agg_13_unit_counts",
    WITH + f""", per AS (SELECT unnest(['clauses', 'strict_views', 'linked_views', 'mentions', 'propositions']) AS unit, unnest([
        (SELECT count(*) FROM clause c WHERE c.tid = d.tid), (SELECT count(*) FROM view v WHERE v.tid = d.tid AND kind = 'strict'), (SELECT count(*) FROM linked v WHERE v.tid = d.tid),
        (SELECT count(*) FROM mention m WHERE m.tid = d.tid), (SELECT count(*) FROM prop p WHERE p.tid = d.tid)]) AS v FROM docs_t d)
    SELECT unit, {_DESCRIBED}, CAST(sum(v) AS BIGINT) AS total FROM per GROUP BY unit""",
)
def agg_13(spark, d):
    r = reports(ship(spark), d)
    found = L.mentions(r)
    return _described(I.unit_counts(r, L.clauses(r), L.text_views(r), found, L.propositions(found)), "unit", "total")


_CHECKS = "positive_score negative_score unknown_is_empty resolved_has_evidence evidence_is_provenance first_evidence_wins at_most_three detectors_known summary_fields conflict_is_lower spans_in_text evidence_in_views".split()


@register("agg_04_audit", f"SELECT unnest({_CHECKS}) AS \"check\", CAST(0 AS BIGINT) AS issues")
def agg_04(spark, d):
    return I.audit(_rows(spark, d), L.text_views(reports(ship(spark), d)))


_CHECK_BASE = ("status_score", "unknown_is_empty", "resolved_has_evidence", "at_most_three", "confidence_range")


@register("agg_03_base_audit", f"SELECT unnest({list(_CHECK_BASE)}) AS \"check\", CAST(0 AS BIGINT) AS issues")
def agg_03(spark, d):
    rows, s = L.supervision(reports(ship(spark), d), "v2"), F.col("status")
    bad = ((s == "positive") & (F.col("derived_score") < 0.85) | (s == "negative") & (F.col("derived_score") != 0), (s == "unknown") & (F.size("evidence") > 0), (s != "unknown") & (F.size("evidence") == 0), F.size("evidence") > 3, ~F.col("confidence").between(0, 1))
    row = rows.agg(*[F.count_if(b).alias(c) for c, b in zip(_CHECK_BASE, bad, strict=True)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("issues")) for c in _CHECK_BASE])).alias("x")).select("x.*")


@register("prj_06_closed_set", WITH + "SELECT study, target, status IN ('positive', 'negative') AS resolved FROM final")
def prj_06(spark, d):
    return _rows(spark, d).select("study", "target", F.col("status").isin("positive", "negative").alias("resolved"))


@register("prj_07_conflict_predicate", WITH + "SELECT count(*) AS n, count(*) FILTER (conflict) AS n_conflict FROM final LEFT JOIN resolved USING (tid, target)")
def prj_07(spark, d):
    return _rows(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rationale").contains("conflict")).alias("n_conflict"))


@register("prj_08_regex_predicate", WITH + "SELECT study, target, status <> 'unknown' AS explicit FROM final")
def prj_08(spark, d):
    return _rows(spark, d).select("study", "target", F.col("rationale").rlike("target-specific .* proposition|collective .* proposition").alias("explicit"))


@register("prj_10_support_scope", "SELECT conv_id, CASE WHEN count(DISTINCT role) > 1 THEN 'strict_and_linked' WHEN min(role) = 'assistant' THEN 'linked_only' ELSE 'strict_only' END AS scope FROM conversations WHERE role IN ('user', 'assistant') GROUP BY conv_id")
def prj_10(spark, d):
    kind = F.when(F.col("role") == "assistant", "linked").otherwise("strict")
    rows = table(spark, d, "conversations").where(F.col("role").isin("user", "assistant")).groupBy("conv_id").agg(F.collect_list(kind).alias("kinds"))
    return rows.select("conv_id", I.support_scope(F.col("kinds")).alias("scope"))


@register("prj_11_resolution_mode", WITH + "SELECT study, target, CASE WHEN conflict THEN 'conflict' WHEN whole THEN 'collective' WHEN f.status = 'unknown' THEN 'unresolved' ELSE 'target_specific' END AS mode FROM final f LEFT JOIN resolved r USING (tid, target)")
def prj_11(spark, d):
    return _rows(spark, d).select("study", "target", I.resolution_mode(F.col("rationale")).alias("mode"))


@register("prj_12_confidence_rank", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN CASE WHEN doc_id % 2 = 0 THEN 0.8::DOUBLE ELSE 0.9::DOUBLE END WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 0.75::DOUBLE ELSE 0.85::DOUBLE END ELSE CASE WHEN doc_id % 2 = 0 THEN 0.45::DOUBLE ELSE 0.5::DOUBLE END END AS confidence FROM documents")
def prj_12(spark, d):
    status = F.when(F.col("doc_id") % 3 == 0, "positive").when(F.col("doc_id") % 3 == 1, "negative").otherwise("uncertain")
    rank = I.rank_confidence(status, F.lit("v2_exact"), F.col("doc_id") % 2 == 0)
    return table(spark, d, "documents").select("doc_id", F.round(rank, 6).alias("confidence"))


@register("txt_13_structural_rewrite", "SELECT doc_id AS study, CASE doc_id % 2 WHEN 0 THEN 'grade ii stupnja' ELSE 'mcl: high grade' END AS text FROM documents")
def txt_13(spark, d):
    raw = F.when(F.col("study") % 2 == 0, "Grade II. stupnja").otherwise("MCL ; high grade")
    n = X.normalize(raw)
    n = F.regexp_replace(n, r"\b([ivx]+)\.\s+(?=(?:stupnja|stepena|grad)\b)", "$1 ")
    n = F.regexp_replace(n, r"\b((?:deep|superficial)\s+)?(acl|pcl|mcl|lcl)\s*;\s*(?=high|low|grade|partial|complete|intact|normal|tear|sprain)", "$1$2: ")
    return docs(spark, d).select("study", n.alias("text"))


@register("txt_20_merged_spans", None)
def txt_20(spark, d):
    merged = X.let(X.normalize(F.col("report")), lambda n: X.merge_spans(X.spans(n, X.term_pattern(("the",))), X.spans(n, r"(?U)\b(?:the|th\w+)\b")))
    return docs(spark, d).select("study", F.size(merged).alias("n_spans"))


_PHENOTYPES = r"""CASE WHEN status = 'negative' THEN 'abnormality_absent' WHEN regexp_matches(evidence, 'tear|torn|rupture|rotura') THEN 'tear' WHEN regexp_matches(evidence, 'fracture') THEN 'fracture'
    WHEN regexp_matches(evidence, 'degenerat|mucoid') THEN 'degeneration' WHEN regexp_matches(evidence, 'chondrosis|cartilage|kraakbeen') THEN 'chondral_abnormality' ELSE 'abnormality' END"""


@register("txt_22_phenotype", WITH + f"SELECT DISTINCT evidence, status, {_PHENOTYPES} AS phenotype FROM inventory")
def txt_22(spark, d):
    return _inventory(spark, d).select("evidence", "status", I.phenotype(F.col("evidence"), F.col("status")).alias("phenotype")).distinct()


@register("txt_26_uncertainty_markers", WITH + "SELECT study, m AS marker FROM docs_t, (VALUES ('possible'), ('possibly'), ('suspected')) v(m) WHERE regexp_matches(lower(report), '\\b' || m || '\\b')")
def txt_26(spark, d):
    rows = reports(spark, d).select("study", F.explode(I.uncertainty_markers(X.normalize(F.col("report")))).alias("marker"))
    return rows.where(F.col("marker") != I.DEFAULT_MARKER)


@register("txt_28_jaccard", r"WITH t AS (SELECT doc_id, list_distinct(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS a, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS b FROM documents) SELECT doc_id AS study, CASE WHEN len(a) + len(b) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b)) / len(list_distinct(a || b)) END AS similarity FROM t")
def txt_28(spark, d):
    return docs(spark, d).select("study", X.jaccard(F.array_distinct(X.tokens(F.col("report"))), F.array_distinct(X.tokens(F.lower("report")))).alias("similarity"))


@register("txt_30_explicit_cue", WITH + r"SELECT study, regexp_matches(lower(report), '\bacl\b') AS names_acl, regexp_matches(lower(report), 'effusion|sıvı|gelenkerguss') AS names_effusion, regexp_matches(lower(report), '(medial|lateral)\p{L}* menis') AS names_meniscus FROM docs_t")
def txt_30(spark, d):
    n = X.normalize(F.col("report"))
    return reports(spark, d).select("study", I.explicit_cue("ACL", n).alias("names_acl"), I.explicit_cue("Effusion", n).alias("names_effusion"), (I.explicit_cue("Medial Meniscus", n) | I.explicit_cue("Lateral Meniscus", n)).alias("names_meniscus"))


@register("txt_32_report_length", r"SELECT doc_id AS study, CAST(length(text) AS INT) AS characters, CAST(len(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS INT) AS words FROM documents")
def txt_32(spark, d):
    return docs(spark, d).select("study", F.length("report").alias("characters"), F.size(X.tokens(F.col("report"))).alias("words"))


@register("agg_16_hypotheses", "WITH h AS (SELECT doc_id, unnest(['x', lang]) AS hypothesis FROM documents) SELECT hypothesis, count(*) AS n FROM h GROUP BY hypothesis")
def agg_16(spark, d):
    rows = docs(spark, d).select("study", F.explode(F.array(F.lit("x"), F.col("lang"))).alias("hypothesis"))
    return rows.groupBy("hypothesis").agg(F.count(F.lit(1)).alias("n"))


@register("agg_39_agreement", WITH + ", n AS (SELECT target, count(*) AS n, count(*) FILTER (coalesce(b.status, 'unknown') = f.status) AS agree FROM final f LEFT JOIN base_resolved b USING (tid, target) GROUP BY ROLLUP (target)) SELECT coalesce(target, 'all') AS target, n, agree, agree / n AS rate FROM n")
def agg_39(spark, d):
    old = L.supervision(reports(ship(spark), d), "v2").select("study", "target", F.col("status").alias("old"))
    both = old.join(_rows(spark, d).select("study", "target", "status"), ["study", "target"])
    return both.rollup("target").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("old") == F.col("status")).alias("agree")).select(F.coalesce("target", F.lit("all")).alias("target"), "n", "agree", (F.col("agree") / F.col("n")).alias("rate"))


_J = "j AS (SELECT lang, quality AS t, CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id))"


@register("agg_41_mean_macro_f1", f"""WITH {_J}, l AS (SELECT unnest([0, 1]) AS label), g AS (SELECT lang, label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (p = label) AS np, count(*) FILTER (t = label) AS s FROM j, l GROUP BY lang, label),
    m AS (SELECT lang, avg(coalesce(2 * tp / nullif(np + s, 0), 0)) FILTER (s > 0) AS f1 FROM g GROUP BY lang) SELECT round(avg(f1), 9) AS mean_macro_f1 FROM m""")
def agg_41(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id").select("lang", F.col("quality").alias("t"), (F.col("n_chars") >= 500).cast("int").alias("p"))
    macro = M.averages(M.class_metrics(rows, ["lang"], "t", "p", [0, 1]), ["lang"])
    return macro.agg(F.round(F.avg("macro_f1"), 9).alias("mean_macro_f1"))


@register("agg_43_test_slices", """WITH k AS (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r, max(CASE WHEN doc_id % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY text) AS in_train FROM documents), te AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rt FROM k WHERE doc_id % 3 = 0),
    s AS (SELECT unnest(list_filter(['ALL', CASE WHEN rt = 1 THEN 'UNIQUE' END, CASE WHEN rt = 1 AND in_train = 0 THEN 'NOVEL' END], lambda x: x IS NOT NULL)) AS slice FROM te) SELECT slice, count(*) AS n FROM s GROUP BY slice""")
def agg_43(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "text")
    test = T.novelty(rows.where("doc_id % 3 = 0"), rows.where("doc_id % 3 != 0"), ["text"])
    first = R.first_per_group(test, ["text"], F.col("doc_id")).select("doc_id", F.lit(True).alias("is_first"))
    marked = test.join(first, "doc_id", "left")
    names = F.filter(F.array(F.lit("ALL"), F.when(F.col("is_first"), "UNIQUE"), F.when(F.col("is_first") & F.col("is_novel"), "NOVEL")), lambda x: x.isNotNull())
    return marked.select(F.explode(names).alias("slice")).groupBy("slice").agg(F.count(F.lit(1)).alias("n"))


@register("agg_44_split_summary", None)
def agg_44(spark, d):
    rows = docs(spark, d).select("study", X.sha256(F.col("report")).alias("family"), "lang")
    return R.grouping_sets(T.assign_splits(rows, "study", "family", ["lang"]), ["split", "lang"], [["split"], ["split", "lang"]], F.count(F.lit(1)).alias("n"), F.count_distinct("split_group").alias("n_groups"))


@register("agg_55_language_target_rates", WITH + "SELECT lang, avg(CASE WHEN status = 'unknown' THEN 1.0::DOUBLE ELSE 0 END) FILTER (target = 'ACL') AS acl, avg(CASE WHEN status = 'unknown' THEN 1.0::DOUBLE ELSE 0 END) FILTER (target = 'MCL') AS mcl FROM final JOIN documents ON doc_id = study GROUP BY lang")
def agg_55(spark, d):
    rows = _rows(spark, d).join(docs(spark, d).select("study", "lang"), "study")
    open_ = F.when(F.col("status") == "unknown", 1.0).otherwise(0.0)
    return rows.groupBy("lang").agg(F.avg(F.when(F.col("target") == "ACL", open_)).alias("acl"), F.avg(F.when(F.col("target") == "MCL", open_)).alias("mcl"))


@register("agg_59_scenarios", WITH + """, s AS (SELECT target, official_label AS t, unnest(['as_is', 'unknown_negative']) AS scenario, unnest([derived_label, CASE WHEN status = 'unknown' THEN 0 ELSE derived_label END]) AS p FROM final WHERE official_label IS NOT NULL)
    SELECT scenario, count(*) AS n, count(p) AS resolved, count(*) FILTER (t = 1 AND p = 1) AS tp, count(*) FILTER (t = 0 AND p = 0) AS tn FROM s GROUP BY scenario""")
def agg_59(spark, d):
    p = F.col("derived_label")
    pairs = F.explode(F.array(F.struct(F.lit("as_is").alias("scenario"), p.alias("p")), F.struct(F.lit("unknown_negative").alias("scenario"), F.when(F.col("status") == "unknown", 0).otherwise(p).alias("p"))))
    rows = _rows(spark, d).where("official_label IS NOT NULL").select("official_label", pairs.alias("x")).select("official_label", "x.*")
    return M.binary_metrics(rows, ["scenario"], F.col("official_label"), F.col("p")).select("scenario", "n", "resolved", "tp", "tn")


@register(
    "dst_04_collapse",
    WITH + """, x AS (SELECT study, target, status, detectors, confidence, unnest(source_indices) AS idx FROM inventory)
    SELECT study, target, idx, status, array_to_string(list_sort(list_distinct(flatten(list(detectors)))), '+') AS detectors, max(confidence) AS confidence, count(*) AS n_merged FROM x GROUP BY study, target, idx, status""",
)
def dst_04(spark, d):
    rows = _inventory(spark, d).withColumn("idx", F.explode("source_indices"))
    return T.collapse(rows, ["study", "target", "idx", "status"]).withColumns({"detectors": F.array_join("detectors", "+"), "confidence": F.round("confidence", 6)})


@register("dst_08_unique_slice", "SELECT min(doc_id) AS doc_id, lang FROM documents GROUP BY text, lang")
def dst_08(spark, d):
    return R.first_per_group(table(spark, d, "documents").select("doc_id", "text", "lang"), ["text", "lang"], F.col("doc_id")).select("doc_id", "lang")


@register("jon_24_manifest", "SELECT doc_id, doc_id % 5 AS fold FROM documents")
def jon_24(spark, d):
    manifest = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 5).alias("fold"))
    return table(spark, d, "documents").select("doc_id").join(manifest, "doc_id")


@register(
    "agg_33_example_structure",
    WITH + """, w AS (SELECT * FROM inventory WHERE winning), r AS (SELECT target, status, detector || '::' || rule AS dr FROM (SELECT target, status, unnest(detectors) AS detector, rules FROM w) x,
      unnest(CASE WHEN len(rules) = 0 THEN ['<no_explicit_rule>'] ELSE rules END) u(rule)),
    c AS (SELECT target, status, string_agg(DISTINCT dr, '|' ORDER BY dr) AS detector_rules, count(DISTINCT dr) AS n_detector_rules FROM r GROUP BY ALL)
    SELECT target, status, count(*) AS n, count(DISTINCT evidence) AS n_evidence, count(DISTINCT study) AS n_studies, count(DISTINCT tid) AS n_exact_families, count(DISTINCT tid) AS n_numeric_families,
      string_agg(DISTINCT language_group, '|' ORDER BY language_group) AS languages, any_value(detector_rules) AS detector_rules, any_value(n_detector_rules) AS n_detector_rules
    FROM w JOIN c USING (target, status) GROUP BY target, status""",
)
def agg_33(spark, d):
    families = P.families(reports(spark, d).select("study", "report"), "report")
    return I.example_structure(_inventory(spark, d), families).withColumns({c: F.array_join(c, "|") for c in ("languages", "detector_rules")})


@register(
    "snk_06_study_distribution",
    WITH + f""", p AS (SELECT study, count(*) AS np, count(DISTINCT evidence) AS ne FROM prop JOIN docs_t USING (tid) GROUP BY study),
    s AS (SELECT study, count(*) FILTER (status IN ('positive', 'negative')) AS b, count(*) FILTER (status = 'positive') AS a1, count(*) FILTER (status = 'negative') AS a2, count(*) FILTER (status = 'uncertain') AS a3, count(*) FILTER (status = 'unknown') AS a4 FROM final GROUP BY study),
    x AS (SELECT unnest(['binary_resolved_targets', 'positive_targets', 'negative_targets', 'uncertain_targets', 'unknown_targets', 'propositions', 'unique_evidence_fragments']) AS measure, unnest([b, a1, a2, a3, a4, coalesce(np, 0), coalesce(ne, 0)]) AS v FROM s LEFT JOIN p USING (study))
    SELECT measure, {_DESCRIBED} FROM x GROUP BY measure""",
)
def snk_06(spark, d):
    found = L.mentions(reports(ship(spark), d))
    return _described(I.study_distribution(_rows(spark, d), L.propositions(found)), "measure")


_UNKNOWN_GOLD = "u AS (SELECT f.*, t.language_group FROM final f JOIN docs_t t USING (study) WHERE status = 'unknown' AND official_label IS NOT NULL)"


@register("agg_61_weight_sensitivity", WITH + f", {_UNKNOWN_GOLD} SELECT w AS weight, w * count(*) AS added_examples, w * sum(official_label) AS false_negative_mass, sum(official_label) / count(*) AS incorrect_share FROM u, (SELECT unnest([0.10::DOUBLE, 0.25, 0.50, 1.00]) AS w) GROUP BY w")
def agg_61(spark, d):
    return I.weight_sensitivity(_rows(spark, d))


@register("agg_61_language_safety", WITH + f", {_UNKNOWN_GOLD} SELECT language_group, count(*) AS unknown_n, CAST(sum(official_label) AS BIGINT) AS false_negative, CAST(count(*) - sum(official_label) AS BIGINT) AS correct_negative, (count(*) - sum(official_label)) / count(*) AS safety FROM u GROUP BY language_group")
def agg_61b(spark, d):
    return I.language_safety(_rows(spark, d))


@register("agg_62_positive_misses", WITH + ", m AS (SELECT t.language_group, target FROM final JOIN docs_t t USING (study) WHERE official_label = 1 AND status IN ('unknown', 'uncertain')) SELECT language_group, " + ", ".join("count(*) FILTER (target = '" + t.replace("'", "''") + f"') AS \"{t}\"" for t in V.TARGETS) + " FROM m GROUP BY language_group")
def agg_62(spark, d):
    return I.positive_misses(_rows(spark, d))


@register("det_17_guard_keys", WITH + "SELECT DISTINCT study, idx, target FROM (SELECT study, target, unnest(sources) AS idx FROM mention JOIN docs_t USING (tid))")
def det_17(spark, d):
    return T.guard_keys(L.mentions(reports(ship(spark), d)))


@register("src_07_header_values", r"SELECT conv_id, nullif(trim(array_to_string(list_sort(list(role)), '\')), '') AS roles FROM conversations GROUP BY conv_id")
def src_07(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list("role")).alias("r")).select("conv_id", header_value(F.col("r")).alias("roles"))
