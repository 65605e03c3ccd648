"""From reports to labels: clauses, views, mentions, propositions and one label per study and target.

Segmentation and detection run as Arrow UDFs over one report at a time; reconciliation is aggregation
by (study, target) and array expressions over the few mentions of a group.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from reportmill.functions import clauses as C
from reportmill.functions import morphology as M
from reportmill.functions import text as X
from reportmill.functions import vocabulary as V

CLAUSE = "array<struct<idx:int,text:string,section:string,diagnostic:boolean>>"
VIEW = "array<struct<text:string,section:string,diagnostic:boolean,kind:string,sources:array<int>>>"
HIT = "array<struct<target:string,status:string,text:string,collective:boolean,rule:string>>"
MENTION = (
    "array<struct<target:string,status:string,phenotype:string,text:string,detector:string,view_kind:string,language:string,confidence:double,"
    "section:string,source_indices:array<int>,span:struct<s:int,e:int>,collective:boolean,rule:string>>"
)
POSTPONED = {"positive": 3, "uncertain": 2, "negative": 1, "unknown": 0}


def _udf(f, kind: str):
    """An Arrow UDF of one column of reports; f and the conversion of its rows run once for each distinct report of a batch."""
    out = T.DataType.fromDDL(kind)
    arrow = to_arrow_type(out)

    def named(x, t):
        if x is None or not isinstance(t, T.ArrayType | T.StructType):
            return x
        if isinstance(t, T.ArrayType):
            return [named(v, t.elementType) for v in x]
        return {c.name: named(v, c.dataType) for c, v in zip(t.fields, x, strict=True)}

    def work(reports: pa.Array) -> pa.Array:
        each = pc.dictionary_encode(reports, null_encoding="encode")
        return pa.array([named(f(x), out) for x in each.dictionary.to_pylist()], arrow).take(each.indices)

    return F.arrow_udf(work, out)


def clause_array(report: Column) -> Column:
    return _udf(lambda x: [(i, *c) for i, c in enumerate(C.segment(x))], CLAUSE)(report)


def view_array(report: Column) -> Column:
    return _udf(lambda x: [(*v[:4], list(v.sources)) for v in C.views(C.segment(x))], VIEW)(report)


def base_hit_array(report: Column, leak: bool = False) -> Column:
    def work(x):
        found = C.segment(x)
        return [(t, s, found[i].text, c, r) for t, hits in C.base_hits(found, leak).items() for s, i, c, r in hits]

    return _udf(work, HIT)(report)


def mention_array(report: Column, leak: bool = False) -> Column:
    row = lambda f: (*f[:9], list(f.sources), f.span, f.collective, f.rule)
    return _udf(lambda x: [row(f) for f in C.findings(x, leak)], MENTION)(report)


def joined_lines(text: Column) -> Column:
    """Wrapped lines joined by an array fold (the state is the lines so far, the last one's indent and whether it may go on)."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("indent"), F.lit(False).alias("glue"))

    def step(a: Column, line: Column) -> Column:
        body = F.trim(line)
        indent = F.length(line) - F.length(F.ltrim(line))
        head = F.rtrim(F.element_at(a["out"], -1))
        lower = (F.upper(F.substring(body, 1, 1)) != F.substring(body, 1, 1)) & (F.lower(F.substring(body, 1, 1)) == F.substring(body, 1, 1))
        open_end = head.endswith(",") | ((F.length(head) >= 35) & ~head.rlike(r"[.!?;:]$"))
        goes_on = a["glue"] & (F.size(a["out"]) > 0) & (indent == a["indent"]) & lower & open_end
        glued = F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(F.concat(head, F.lit(" "), body)))
        added = F.concat(a["out"], F.array(body))
        new = F.when(goes_on, F.struct(glued.alias("out"), a["indent"].alias("indent"), F.lit(True).alias("glue"))).otherwise(
            F.struct(added.alias("out"), indent.alias("indent"), F.lit(True).alias("glue"))
        )
        return F.when(body == "", F.struct(a["out"].alias("out"), a["indent"].alias("indent"), F.lit(False).alias("glue"))).otherwise(new)

    return F.array_join(F.aggregate(F.split(text, "\n", -1), start, step)["out"], "\n")


def clauses(reports: DataFrame) -> DataFrame:
    """(study, idx, text, section, diagnostic)."""
    return reports.select("study", F.inline(clause_array(F.col("report"))))


def text_views(reports: DataFrame) -> DataFrame:
    """(study, view_no, text, section, diagnostic, kind, sources): strict views of each clause, then linked pairs."""
    return reports.select("study", F.posexplode(view_array(F.col("report"))).alias("view_no", "v")).select("study", "view_no", "v.*")


def base_mentions(reports: DataFrame, leak: bool = False) -> DataFrame:
    """(study, ord, target, status, text, collective, rule) of the base policy."""
    return reports.select("study", F.posexplode(base_hit_array(F.col("report"), leak)).alias("ord", "m")).select("study", "ord", "m.*")


def mentions(reports: DataFrame, leak: bool = False) -> DataFrame:
    """All mentions of the morphology policy with their order in the report."""
    return reports.select("study", F.posexplode(mention_array(F.col("report"), leak)).alias("ord", "m")).select("study", "ord", "m.*")


def target_table(spark) -> DataFrame:
    """The closed, ordered domain of targets (12 rows)."""
    return spark.createDataFrame(list(enumerate(V.TARGETS)), "ord int, target string")


def grid(studies: DataFrame) -> DataFrame:
    """Every study with every target."""
    return studies.withColumn("target", F.explode(F.array(*[F.lit(t) for t in V.TARGETS])))


def _others(pairs: DataFrame) -> list[str]:
    return [c for c in pairs.columns if c not in ("study", "target")]


# --- reconciliation

def _winner(items: Column) -> Column:
    has = lambda s: F.exists(items, lambda m: m["status"] == s)
    return F.when(has("positive"), "positive").when(has("uncertain"), "uncertain").when(has("negative"), "negative").otherwise("unknown")


def resolve_base(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The studies and targets of pairs under the base policy, with their other columns at the end; absent evidence is unknown, never negative."""
    rows = found.groupBy("study", "target").agg(F.sort_array(F.collect_list(F.struct("ord", "status", "text", "collective"))).alias("m"))
    rows = pairs.join(rows, ["study", "target"], "left").withColumn("m", F.coalesce("m", F.array().cast("array<struct<ord:int,status:string,text:string,collective:boolean>>")))
    rows = rows.withColumn("status", _winner(F.col("m")))
    rows = rows.withColumn("w", F.filter("m", lambda x: x["status"] == F.col("status")))
    rows = rows.withColumn("c", F.filter("m", lambda x: (x["status"] != F.col("status")) & ~F.array_contains("w.text", x["text"])))
    rows = rows.withColumn("all_collective", F.forall("w", lambda x: x["collective"])).withColumn("conflict", F.size("c") > 0)
    s, g, k = F.col("status"), F.col("all_collective"), F.col("conflict")
    score = (
        F.when(s == "positive", F.when(k, F.when(g, 0.85).otherwise(0.90)).otherwise(F.when(g, 0.85).otherwise(1.0)))
        .when(s == "uncertain", F.when(g, 0.45).otherwise(0.50)).when(s == "negative", 0.0)
    )
    confidence = (
        F.when(s == "positive", F.when(k, F.when(g, 0.65).otherwise(0.70)).otherwise(F.when(g, 0.80).otherwise(0.90)))
        .when(s == "uncertain", F.when(g, 0.45).otherwise(0.50)).when(s == "negative", F.when(g, 0.75).otherwise(0.85)).otherwise(0.0)
    )
    rationale = (
        F.when((s == "positive") & k, F.when(g, "collective positive evidence retained with conflicting mentions").otherwise("positive evidence retained with conflicting mentions"))
        .when(s == "positive", F.when(g, "explicit collective positive evidence").otherwise("explicit positive evidence"))
        .when(s == "uncertain", F.concat(F.when(g, "explicit collective uncertain evidence").otherwise("explicit uncertain evidence"), F.when(k, " retained with negative mentions").otherwise("")))
        .when(s == "negative", F.when(g, "explicit collective negation or normality").otherwise("explicit negation or normality"))
        .otherwise("no reliable target-specific evidence")
    )
    ordered = F.concat(F.filter("w", lambda x: ~x["collective"]), F.filter("w", lambda x: x["collective"]))
    chosen = F.when(k, F.concat(F.slice(ordered, 1, 2), F.slice("c", 1, 1))).otherwise(ordered)
    evidence = F.slice(F.array_distinct(F.transform(chosen, lambda x: F.substring(x["text"], 1, 500))), 1, 3)
    return rows.select(
        "study", "target", s, F.when(s == "positive", 1).when(s == "negative", 0).alias("derived_label"), score.alias("derived_score"),
        confidence.alias("confidence"), evidence.alias("evidence"), rationale.alias("rationale"), *_others(pairs),
    )


def propositions(found: DataFrame) -> DataFrame:
    """Mentions that say the same in the same text, as one row with all their support."""
    priority = lambda d: F.element_at(F.create_map(*[F.lit(x) for kv in M.DETECTOR_PRIORITY.items() for x in kv]), d)
    distinct = lambda c: F.array_sort(F.collect_set(c))
    rows = found.groupBy("study", "target", "status", "phenotype", F.col("text").alias("evidence")).agg(
        F.min("ord").alias("ord"), F.sort_array(F.collect_set(F.struct((-priority(F.col("detector"))).alias("p"), "detector"))).alias("d"),
        distinct("view_kind").alias("view_kinds"), distinct("language").alias("languages"), distinct("section").alias("sections"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_indices")))).alias("source_indices"), distinct("span").alias("spans"),
        F.max("confidence").alias("confidence"), F.bool_and("collective").alias("collective"), distinct("rule").alias("rules"),
    )
    return rows.withColumn("detectors", F.col("d.detector")).withColumn("priority", -F.get("d", F.lit(0))["p"]).drop("d")


PROVENANCE = ("status", "phenotype", "evidence", "detectors", "view_kinds", "languages", "sections", "source_indices", "spans", "confidence", "collective", "rules")


def resolve_propositions(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """The studies and targets of pairs under the morphology policy, with nested provenance and their other columns at the end."""
    item = F.struct((-F.col("priority")).alias("p"), (-F.col("confidence")).alias("c"), F.col("evidence").alias("t"), "ord", F.struct(*PROVENANCE).alias("v"), "status")
    rows = found.groupBy("study", "target").agg(F.array_sort(F.collect_list(item)).alias("m"))
    rows = pairs.join(rows, ["study", "target"], "left")
    rows = rows.withColumn("status", F.when(F.col("m").isNull(), "unknown").otherwise(_winner(F.col("m"))))
    rows = rows.withColumn("w", F.filter("m", lambda x: x["status"] == F.col("status")))
    rows = rows.withColumn("c", F.filter("m", lambda x: (x["status"] != F.col("status")) & ~F.array_contains("w.t", x["t"])))
    s, k = F.col("status"), F.size("c") > 0
    top = -F.array_min("w.c")
    confidence = F.when(s == "unknown", 0.0).when(k, F.greatest(F.lit(0.40), top - M.CONFIDENCE["conflict_penalty"])).otherwise(top)
    mode = F.when(F.forall("w", lambda x: x["v"]["collective"]), "collective").otherwise("target-specific")
    rationale = F.when(s == "unknown", "no reliable target-specific proposition").otherwise(
        F.concat(F.lit("v3 "), mode, F.lit(" "), s, F.lit(" proposition"), F.when(k, " retained with conflicting proposition").otherwise(""))
    )
    chosen = F.col("chosen")
    rows = rows.withColumn("chosen", F.coalesce(F.concat(F.slice("w", 1, 2), F.slice("c", 1, 1))["v"], F.array()))
    return rows.select(
        "study", "target", s, F.when(s == "positive", 1).when(s == "negative", 0).alias("derived_label"),
        F.when(s == "positive", 1.0).when(s == "uncertain", 0.5).when(s == "negative", 0.0).alias("derived_score"), F.round(confidence, 6).alias("confidence"),
        chosen["evidence"].alias("evidence"), rationale.alias("rationale"), F.array_distinct(chosen["phenotype"]).alias("phenotypes"),
        F.array_distinct(F.flatten(chosen["detectors"])).alias("detectors"), chosen.alias("evidence_provenance"), *_others(pairs),
    )


# --- supervision

BASE_POLICY, MORPHOLOGY_POLICY = "report-label-policy-v2.0.0", "report-label-policy-v3.0.0"


def _official() -> Column:
    return F.array(*[F.struct(F.lit(t).alias("target"), F.col(f"`{t}`").cast("int").alias("official_label")) for t in V.TARGETS])


def official_labels(reports: DataFrame) -> DataFrame:
    """(study, target, official_label) of the wide nullable target columns."""
    return reports.select("study", F.inline(_official()))


def study_targets(reports: DataFrame) -> DataFrame:
    """(study, target, official_label, report_sha256, language_group) of all targets; made of each report alone, so that nothing is joined."""
    rows = reports.where("study IS NOT NULL").select("study", X.normalize(F.col("report")).alias("norm"), _official().alias("official"))
    rows = rows.select("study", "official", X.sha256(F.col("norm")).alias("report_sha256"), X.language_group(F.col("norm")).alias("language_group"))
    return rows.select("study", F.inline("official"), "report_sha256", "language_group")


def supervision(reports: DataFrame, policy: str = "v3", leak: bool = False, found: DataFrame | None = None) -> DataFrame:
    """The long supervision table: derived and official labels, the final one and its source. found: mentions made before."""
    pairs = study_targets(reports)
    if policy == "v2":
        rows, version = resolve_base(base_mentions(reports, leak) if found is None else found, pairs), BASE_POLICY
    else:
        rows, version = resolve_propositions(propositions(mentions(reports, leak) if found is None else found), pairs), MORPHOLOGY_POLICY
    official, own = F.col("official_label"), F.col("derived_label")
    source = F.when(official.isNotNull(), "official").when(own.isNotNull(), "report_derived").otherwise("unresolved")
    return rows.withColumn("final_label", F.coalesce(official, own)).withColumn("final_source", source).withColumn("policy_version", F.lit(version))


def input_violations(reports: DataFrame) -> DataFrame:
    """(check, n): counts of broken input rules in one pass; all zero for a good table."""
    labels = F.array(*[F.col(f"`{t}`").cast("double") for t in V.TARGETS])
    known = F.size(F.filter(labels, lambda x: x.isNotNull()))
    bad = {
        "null_study": F.count_if(F.col("study").isNull()), "null_report": F.count_if(F.col("report").isNull()),
        "repeated_study": F.count("study") - F.count_distinct("study"), "partial_labels": F.count_if((known > 0) & (known < len(V.TARGETS))),
        "label_domain": F.count_if(F.exists(labels, lambda x: ~x.isin(0.0, 1.0))),
    }
    row = reports.agg(*[n.cast("long").alias(c) for c, n in bad.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in bad])).alias("x")).select("x.*")


def output_violations(rows: DataFrame) -> DataFrame:
    """(check, n) of the supervision table's rules in one pass."""
    s, d, f, o = F.col("status"), F.col("derived_label"), F.col("final_label"), F.col("official_label")
    n_pairs = F.count(F.lit(1)) - F.count_distinct("study", "target")
    bad = {
        "repeated_pair": n_pairs, "target_domain": F.count_if(~F.col("target").isin(*V.TARGETS)),
        "status_domain": F.count_if(~s.isin("positive", "negative", "uncertain", "unknown")),
        "source_domain": F.count_if(~F.col("final_source").isin("official", "report_derived", "unresolved")),
        "positive_label": F.count_if((s == "positive") & ~d.eqNullSafe(1)), "negative_label": F.count_if((s == "negative") & ~d.eqNullSafe(0)),
        "open_label": F.count_if(s.isin("uncertain", "unknown") & d.isNotNull()), "confidence_range": F.count_if(~F.col("confidence").between(0, 1)),
        "official_wins": F.count_if(o.isNotNull() & ~f.eqNullSafe(o)), "derived_fills": F.count_if(o.isNull() & ~f.eqNullSafe(d)),
        "evidence_missing": F.count_if((s != "unknown") & (F.size("evidence") == 0)), "evidence_without_status": F.count_if((s == "unknown") & (F.size("evidence") > 0)),
    }
    row = rows.agg(*[n.cast("long").alias(c) for c, n in bad.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("n")) for c in bad])).alias("x")).select("x.*")
