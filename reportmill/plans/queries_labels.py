"""Registered queries: detection, reconciliation, supervision, its summaries, and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from reportmill.functions import text as X
from reportmill.functions import vocabulary as V
from reportmill.operators import labelling as L
from reportmill.operators import metrics as M
from reportmill.operators import relational as R
from reportmill.plans.corpora import docs, reports
from reportmill.plans.gold import BASE_SQL, GOLD_SQL
from reportmill.plans.registry import register
from reportmill.plans.shipping import ship
from reportmill.sources.tables import table

STATUS = ("positive", "negative", "uncertain", "unknown")
LABEL_SQL = "CASE status WHEN 'positive' THEN 1 WHEN 'negative' THEN 0 END"
FINAL_SQL = (
    f"final AS (SELECT study, tid, target, ord, status, official AS official_label, {LABEL_SQL} AS derived_label, coalesce(official, {LABEL_SQL}) AS final_label, "
    f"CASE WHEN official IS NOT NULL THEN 'official' WHEN status IN ('positive', 'negative') THEN 'report_derived' ELSE 'unresolved' END AS final_source FROM gold)"
)
WITH = f"WITH {GOLD_SQL}, {FINAL_SQL} "
BASE_WITH = f"WITH {BASE_SQL}, {FINAL_SQL} "


def _v3(spark, d):
    return L.supervision(reports(ship(spark), d), "v3")


def _v2(spark, d):
    return L.supervision(reports(ship(spark), d), "v2")


SUPERVISION = ("study", "target", "status", "derived_label", "official_label", "final_label", "final_source")
SUPERVISION_SQL = WITH + "SELECT study, target, status, derived_label, CAST(official_label AS INT) AS official_label, CAST(final_label AS INT) AS final_label, final_source FROM final"


@register("prj_01_supervision_base", SUPERVISION_SQL.replace(WITH, BASE_WITH))
def prj_01(spark, d):
    return _v2(spark, d).select(*SUPERVISION)


@register("prj_02_supervision_morphology", SUPERVISION_SQL)
def prj_02(spark, d):
    return _v3(spark, d).select(*SUPERVISION)


@register("prj_03_input_contract", "SELECT unnest(['null_study', 'null_report', 'repeated_study', 'partial_labels', 'label_domain']) AS \"check\", CAST(0 AS BIGINT) AS n")
def prj_03(spark, d):
    return L.input_violations(reports(spark, d))


@register("prj_04_output_contract", "SELECT unnest(['repeated_pair', 'target_domain', 'status_domain', 'source_domain', 'positive_label', 'negative_label', 'open_label', 'confidence_range', 'official_wins', 'derived_fills', 'evidence_missing', 'evidence_without_status']) AS \"check\", CAST(0 AS BIGINT) AS n")
def prj_04(spark, d):
    return L.output_violations(_v3(spark, d))


@register("txt_06_segment", WITH + "SELECT study, idx, c.text, section, diagnostic FROM docs_t JOIN clause c USING (tid)")
def txt_06(spark, d):
    return L.clauses(reports(ship(spark), d)).select("study", "idx", "text", "section", "diagnostic")


@register("txt_02_line_join", None)
def txt_02(spark, d):
    return docs(spark, d).select("study", X.sha256(L.joined_lines(F.col("report"))).alias("joined_sha256"))


@register("txt_09_views", WITH + "SELECT study, view_no, kind, v.text, section, diagnostic FROM docs_t JOIN view v USING (tid)")
def txt_09(spark, d):
    return L.text_views(reports(ship(spark), d)).select("study", "view_no", "kind", "text", "section", "diagnostic")


@register("det_06_base_statuses", BASE_WITH + "SELECT status, target, count(*) AS n FROM final GROUP BY status, target")
def det_06(spark, d):
    return _v2(spark, d).groupBy("status", "target").agg(F.count(F.lit(1)).alias("n"))


@register("det_11_morphology_statuses", WITH + "SELECT status, target, count(*) AS n FROM final GROUP BY status, target")
def det_11(spark, d):
    return _v3(spark, d).groupBy("status", "target").agg(F.count(F.lit(1)).alias("n"))


_BASE_CONFIDENCE = """CASE g.status WHEN 'positive' THEN CASE WHEN conflict THEN CASE WHEN whole THEN 0.65 ELSE 0.70 END WHEN whole THEN 0.80 ELSE 0.90 END
    WHEN 'uncertain' THEN CASE WHEN whole THEN 0.45 ELSE 0.50 END WHEN 'negative' THEN CASE WHEN whole THEN 0.75 ELSE 0.85 END ELSE 0 END"""


@register("det_05_base_confidence", BASE_WITH + f"SELECT study, g.target, CAST({_BASE_CONFIDENCE} AS DOUBLE) AS confidence, coalesce(conflict, false) AS conflict FROM gold g LEFT JOIN base_resolved r ON r.tid = g.tid AND r.target = g.target")
def det_05(spark, d):
    return _v2(spark, d).select("study", "target", "confidence", F.col("rationale").rlike("conflicting|retained with negative").alias("conflict"))


BASE_ROWS = "SELECT study, ord, target, status, text, collective, rule FROM base JOIN docs_t USING (tid)"


def _base(spark, d):
    return L.base_mentions(reports(ship(spark), d))


def _mentions(spark, d):
    return L.mentions(reports(ship(spark), d))


@register("det_01_base_mentions", BASE_WITH + BASE_ROWS)
def det_01(spark, d):
    return _base(spark, d)


_DIRECT_SQL = "('Effusion', 'Synovitis', 'Baker''s', 'Contusion', 'Fracture')"


@register("det_02_direct_mentions", BASE_WITH + BASE_ROWS + f" WHERE target IN {_DIRECT_SQL} AND NOT collective")
def det_02(spark, d):
    return _base(spark, d).where(F.col("target").isin(*V.DIRECT_TERMS) & ~F.col("collective"))


@register("det_03_tricompartment", BASE_WITH + BASE_ROWS + " WHERE text LIKE '%tricompartmental%' AND target LIKE '% OA'")
def det_03(spark, d):
    return _base(spark, d).where(F.col("target").endswith(" OA") & X.contains_terms(F.col("text"), V.TRICOMPARTMENT_TERMS))


@register("det_04_collective", BASE_WITH + BASE_ROWS + " WHERE rule IS NOT NULL")
def det_04(spark, d):
    return _base(spark, d).where("collective")


MENTION_ROWS = "SELECT study, ord, target, status, phenotype, detector, view_kind, language, conf AS confidence, section, s, e, rule FROM mention JOIN docs_t USING (tid)"


def _mention_rows(spark, d):
    return _mentions(spark, d).select("study", "ord", "target", "status", "phenotype", "detector", "view_kind", "language", F.round("confidence", 6).alias("confidence"), "section", "span.s", "span.e", "rule")


@register("det_07_base_branch", WITH + MENTION_ROWS + " WHERE detector IN ('v2_exact', 'v2_collective')")
def det_07(spark, d):
    return _mention_rows(spark, d).where(F.col("detector").startswith("v2_"))


@register("det_08_mentions", WITH + MENTION_ROWS)
def det_08(spark, d):
    return _mention_rows(spark, d)


@register("det_09_structures", WITH + MENTION_ROWS + " WHERE rule IN ('target_local_association', 'target_local_normality')")
def det_09(spark, d):
    return _mention_rows(spark, d).where(F.col("rule").startswith("target_local"))


@register("det_10_compartments", WITH + MENTION_ROWS + " WHERE rule IN ('compartment_scope', 'compartment_normality')")
def det_10(spark, d):
    return _mention_rows(spark, d).where(F.col("rule").startswith("compartment_"))


@register("txt_23_decisive_phenotypes", WITH + "SELECT study, target, status, phenotype, count(*) AS n FROM mention JOIN docs_t USING (tid) WHERE s IS NOT NULL GROUP BY study, target, status, phenotype")
def txt_23(spark, d):
    return _mentions(spark, d).where("span IS NOT NULL").groupBy("study", "target", "status", "phenotype").agg(F.count(F.lit(1)).alias("n"))


_JOINED = "array_to_string({0}, '+') AS {0}"
_LISTS = ("detectors", "view_kinds", "languages", "sections", "source_indices", "rules")


def _joined(c):
    return F.array_join(F.col(c).cast("array<string>"), "+").alias(c.split(".")[-1])


@register("det_12_propositions", WITH + f"SELECT study, target, status, phenotype, evidence, confidence, collective, {', '.join(_JOINED.format(c) for c in _LISTS)} FROM prop JOIN docs_t USING (tid)")
def det_12(spark, d):
    return L.propositions(_mentions(spark, d)).select("study", "target", "status", "phenotype", "evidence", F.round("confidence", 6).alias("confidence"), "collective", *map(_joined, _LISTS))


@register(
    "det_13_resolved",
    WITH + """SELECT g.study, g.target, g.status, round(CASE WHEN r.tid IS NULL THEN 0 WHEN conflict THEN greatest(0.4, top - 0.18) ELSE top END, 6) AS confidence,
      CASE WHEN r.tid IS NULL THEN 'no reliable target-specific proposition' ELSE 'v3 ' || CASE WHEN whole THEN 'collective' ELSE 'target-specific' END || ' ' || g.status || ' proposition' || CASE WHEN conflict THEN ' retained with conflicting proposition' ELSE '' END END AS rationale,
      coalesce((SELECT string_agg(evidence, '|' ORDER BY place) FROM chosen c WHERE c.tid = g.tid AND c.target = g.target), '') AS evidence
    FROM gold g LEFT JOIN resolved r ON r.tid = g.tid AND r.target = g.target""",
)
def det_13(spark, d):
    return _v3(spark, d).select("study", "target", "status", "confidence", "rationale", F.array_join("evidence", "|").alias("evidence"))


@register("det_14_provenance", WITH + f"SELECT study, target, place, status, phenotype, evidence, confidence, collective, {', '.join(_JOINED.format(c) for c in _LISTS)} FROM inventory")
def det_14(spark, d):
    rows = _v3(spark, d).select("study", "target", F.posexplode("evidence_provenance").alias("place", "p"))
    return rows.select("study", "target", "place", "p.status", "p.phenotype", "p.evidence", F.round("p.confidence", 6).alias("confidence"), "p.collective", *[_joined(f"p.{c}") for c in _LISTS])


@register(
    "det_16_units",
    WITH + """SELECT study, (SELECT count(*) FROM clause c WHERE c.tid = d.tid) AS clauses, (SELECT count(*) FROM view v WHERE v.tid = d.tid) AS views,
      (SELECT count(*) FROM mention m WHERE m.tid = d.tid) AS mentions, (SELECT count(*) FROM prop p WHERE p.tid = d.tid) AS propositions FROM docs_t d""",
)
def det_16(spark, d):
    r = reports(ship(spark), d)
    found = L.mentions(r)
    out = r.select("study")
    for name, units in {"clauses": L.clauses(r), "views": L.text_views(r), "mentions": found, "propositions": L.propositions(found)}.items():
        out = out.join(units.groupBy("study").agg(F.count(F.lit(1)).alias(name)), "study", "left")
    return out.na.fill(0)


@register("agg_06_detector_counts", WITH + "SELECT target, status, detector, count(*) AS n FROM (SELECT target, final_status AS status, unnest(detectors) AS detector FROM inventory) GROUP BY ALL")
def agg_06(spark, d):
    nested = _v3(spark, d).select("target", "status", F.explode("evidence_provenance").alias("p")).select("target", "status", F.explode("p.detectors").alias("detector"))
    return nested.groupBy("target", "status", "detector").agg(F.count(F.lit(1)).alias("n"))


@register("agg_34_evidence_inventory", WITH + "SELECT study, target, place, status, phenotype, evidence, confidence, collective, winning, view_support, detector_combination, CAST(len(source_indices) AS INT) AS source_clause_count, language_group FROM inventory")
def agg_34(spark, d):
    from reportmill.operators import inspection as I

    kept = ("study", "target", "place", "status", "phenotype", "evidence", "collective", "winning", "view_support", "detector_combination", "source_clause_count", "language_group")
    return I.evidence(_v3(spark, d)).select(*kept, F.round("confidence", 6).alias("confidence"))


_RATES = "count(*) FILTER (status = '{0}') AS {0}"


@register("agg_15_target_status", WITH + f"SELECT target, count(*) AS n, {', '.join(_RATES.format(s) for s in STATUS)}, count(*) FILTER (status IN ('positive', 'negative')) / count(*) AS resolved_rate FROM final GROUP BY target")
def agg_15(spark, d):
    counts = R.pivot_counts(_v3(spark, d), ["target"], "status", list(STATUS)).withColumn("n", sum((F.col(s) for s in STATUS), F.lit(0)))
    return counts.withColumn("resolved_rate", (F.col("positive") + F.col("negative")) / F.col("n"))


@register(
    "agg_09_grouping_sets",
    WITH + """, x AS (SELECT f.*, d.lang FROM final f JOIN documents d ON d.doc_id = f.study)
    SELECT target, lang, CASE grouping(target, lang) WHEN 1 THEN 'target' WHEN 2 THEN 'lang' ELSE 'target+lang' END AS level, count(*) AS n, avg(CASE WHEN status IN ('positive', 'negative') THEN 1.0::DOUBLE ELSE 0 END) AS coverage
    FROM x GROUP BY GROUPING SETS ((target), (lang), (target, lang))""",
)
def agg_09(spark, d):
    rows = _v3(spark, d).select("study", "target", "status").join(docs(spark, d).select("study", "lang"), "study")
    resolved = F.avg(F.when(F.col("status").isin("positive", "negative"), 1.0).otherwise(0.0)).alias("coverage")
    return R.grouping_sets(rows, ["target", "lang"], [["target"], ["lang"], ["target", "lang"]], F.count(F.lit(1)).alias("n"), resolved)


@register("agg_10_transitions", WITH + "SELECT target, coalesce(b.status, 'unknown') AS status_old, f.status AS status_new, count(*) AS n FROM final f LEFT JOIN base_resolved b USING (tid, target) GROUP BY ALL")
def agg_10(spark, d):
    return R.transitions(_v2(spark, d), _v3(spark, d), ["study", "target"], "status", ["target"])


@register(
    "agg_08_coverage_ranks",
    WITH + """, c AS (SELECT lang, target, avg(CASE WHEN status IN ('positive', 'negative') THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM final JOIN documents ON doc_id = study GROUP BY lang, target),
    t AS (SELECT target, row_number() OVER (ORDER BY round(avg(rate), 12), target) AS target_rank FROM c GROUP BY target) SELECT lang, target, rate, target_rank FROM c JOIN t USING (target)""",
)
def agg_08(spark, d):
    rows = _v3(spark, d).select("study", "target", "status").join(docs(spark, d).select("study", "lang"), "study")
    rate = rows.groupBy("lang", "target").agg(F.avg(F.when(F.col("status").isin("positive", "negative"), 1.0).otherwise(0.0)).alias("rate"))
    means = rate.groupBy("target").agg(F.round(F.avg("rate"), 12).alias("m"))  # one row a target
    return rate.join(means.select("target", F.row_number().over(Window.orderBy("m", "target")).alias("target_rank")), "target")


@register("agg_30_other_resolved", WITH + ", r AS (SELECT *, count(*) FILTER (status IN ('positive', 'negative')) OVER (PARTITION BY study) AS k FROM final) SELECT target, count(*) AS n, avg(k) AS mean_resolved, quantile_cont(k, 0.9) AS p90_resolved FROM r WHERE status = 'unknown' GROUP BY target")
def agg_30(spark, d):
    resolved = F.count_if(F.col("status").isin("positive", "negative")).over(Window.partitionBy("study"))
    rows = _v3(spark, d).withColumn("k", resolved).where("status = 'unknown'")
    return rows.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.avg("k").alias("mean_resolved"), F.percentile("k", F.lit(0.9)).alias("p90_resolved"))


@register("agg_32_study_pivot", WITH + f"SELECT study, {', '.join(_RATES.format(s) for s in STATUS)} FROM final GROUP BY study")
def agg_32(spark, d):
    return R.pivot_counts(_v3(spark, d), ["study"], "status", list(STATUS))


_PAIRS_SQL = ", p AS (SELECT a.target AS t1, b.target AS t2, count(*) AS n FROM final a JOIN final b ON a.study = b.study AND a.status = 'positive' AND b.status = 'positive' GROUP BY ALL)"


@register("jon_22_cooccurrence", WITH + _PAIRS_SQL + " SELECT x.target AS t1, y.target AS t2, coalesce(p.n, 0) AS n FROM targets x CROSS JOIN targets y LEFT JOIN p ON p.t1 = x.target AND p.t2 = y.target")
def jon_22(spark, d):
    found = _v3(spark, d).where("status = 'positive'").select("study", "target")
    pairs = found.select("study", F.col("target").alias("t1")).join(found.select("study", F.col("target").alias("t2")), "study").groupBy("t1", "t2").agg(F.count(F.lit(1)).alias("n"))
    names = L.target_table(spark).select("target")
    return R.complete_grid(pairs, names.withColumnRenamed("target", "t1"), names.withColumnRenamed("target", "t2"), {"n": 0})


@register("jon_12_grid_completion", WITH + "SELECT d.doc_id AS study, t.target, coalesce(CASE WHEN f.status <> 'unknown' THEN f.status END, 'unknown') AS status FROM documents d CROSS JOIN targets t JOIN final f ON f.study = d.doc_id AND f.target = t.target")
def jon_12(spark, d):
    found = _v3(spark, d).where("status != 'unknown'").select("study", "target", "status")
    return R.complete_grid(found, docs(spark, d).select("study"), L.target_table(spark).select("target"), {"status": "unknown"})


@register(
    "agg_01_gold_metrics",
    WITH + """, m AS (SELECT target, count(*) AS n, count(derived_label) AS resolved, count(*) FILTER (official_label = 1 AND derived_label = 1) AS tp, count(*) FILTER (official_label = 0 AND derived_label = 0) AS tn,
      count(*) FILTER (official_label = 0 AND derived_label = 1) AS fp, count(*) FILTER (official_label = 1 AND derived_label = 0) AS fn FROM final WHERE official_label IS NOT NULL GROUP BY target)
    SELECT *, resolved / n AS coverage, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, tn / nullif(tn + fp, 0) AS specificity,
      (tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2 AS balanced_accuracy FROM m""",
)
def agg_01(spark, d):
    return M.binary_metrics(_v3(spark, d).where("official_label IS NOT NULL"), ["target"], F.col("official_label"), F.col("derived_label"))


@register("agg_02_errors", WITH + "SELECT study, target, CASE WHEN official_label = 0 AND status = 'positive' THEN 'false_positive' WHEN official_label = 1 AND status = 'negative' THEN 'false_negative' ELSE status END AS error FROM final WHERE official_label IS NOT NULL AND (status IN ('unknown', 'uncertain') OR official_label <> derived_label)")
def agg_02(spark, d):
    o, s = F.col("official_label"), F.col("status")
    kind = F.when((o == 0) & (s == "positive"), "false_positive").when((o == 1) & (s == "negative"), "false_negative").when(s.isin("unknown", "uncertain"), s)
    return _v3(spark, d).where(o.isNotNull()).select("study", "target", kind.alias("error")).where("error IS NOT NULL")


_JUDGED = "SELECT lang, quality AS t, CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END AS p FROM documents JOIN labels USING (doc_id)"


def _judged(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id")
    return rows.select("lang", F.col("quality").alias("t"), F.when(F.col("n_chars") >= 500, 1).otherwise(0).alias("p"))


@register(
    "agg_40_class_metrics",
    f"""WITH j AS ({_JUDGED}), l AS (SELECT unnest([0, 1]) AS label), g AS (SELECT lang, label, count(*) FILTER (t = label AND p = label) AS tp, count(*) FILTER (p = label) AS np, count(*) FILTER (t = label) AS support FROM j, l GROUP BY lang, label)
    SELECT lang, label, support, coalesce(tp / nullif(np, 0), 0) AS precision, coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(np + support, 0), 0) AS f1 FROM g""",
)
def agg_40(spark, d):
    return M.class_metrics(_judged(spark, d), ["lang"], "t", "p", [0, 1])


@register("agg_42_confusion", f"WITH j AS ({_JUDGED}) SELECT lang, t AS truth, count(*) FILTER (p = 0) AS as_0, count(*) FILTER (p = 1) AS as_1 FROM j GROUP BY lang, t")
def agg_42(spark, d):
    return M.confusion(_judged(spark, d), ["lang"], "t", "p", [0, 1])


@register(
    "agg_60_wilson",
    f"""WITH j AS ({_JUDGED}), c AS (SELECT lang, count(*) FILTER (t = p) AS k, count(*) AS n, 1.959963984540054::DOUBLE AS z FROM j GROUP BY lang)
    SELECT lang, k, n, round((k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low, round((k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high FROM c""",
)
def agg_60(spark, d):
    rows = _judged(spark, d).groupBy("lang").agg(F.count_if(F.col("t") == F.col("p")).alias("k"), F.count(F.lit(1)).alias("n"))
    w = M.wilson(F.col("k"), F.col("n"))
    return rows.select("lang", "k", "n", F.round(w["low"], 9).alias("low"), F.round(w["high"], 9).alias("high"))


@register(
    "agg_38_precedence",
    """SELECT source, lang, CASE max(CASE WHEN n_chars >= 3000 THEN 3 WHEN n_chars >= 2000 THEN 2 WHEN n_chars >= 500 THEN 1 ELSE 0 END) WHEN 3 THEN 'positive' WHEN 2 THEN 'uncertain' WHEN 1 THEN 'negative' ELSE 'unknown' END AS status,
      count(*) FILTER (n_chars >= 500) AS n_evidence, count(*) AS n_clauses, count(*) FILTER (n_chars >= 3000) > 0 AND count(*) FILTER (n_chars >= 500 AND n_chars < 2000) > 0 AS conflict FROM documents GROUP BY source, lang""",
)
def agg_38(spark, d):
    n = F.col("n_chars")
    label = F.when(n >= 3000, "positive").when(n >= 2000, "uncertain").when(n >= 500, "negative").otherwise("no_evidence")
    return M.aggregate_local(docs(spark, d).withColumn("label", label), ["source", "lang"], "label")


TRUSTED_SQL = """trusted AS (SELECT i.* FROM inventory i JOIN resolved r USING (tid, target) WHERE i.study % 20 <> 0 AND NOT i.collective AND NOT r.conflict AND list_contains(view_kinds, 'strict') AND len(source_indices) = 1
    AND NOT list_contains(detectors, 'v2_collective'))"""


@register("prj_05_trusted_filter", WITH + f", {TRUSTED_SQL} SELECT DISTINCT study, target, status FROM trusted")
def prj_05(spark, d):
    from reportmill.operators.training import trusted

    rows = _v3(spark, d).select("study", "target", "rationale", "official_label", F.explode("evidence_provenance").alias("p")).select("study", "target", "rationale", "official_label", "p.*")
    return trusted(rows).select("study", "target", "status").distinct()
