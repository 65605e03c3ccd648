"""Inspection of a labelled corpus: evidence inventory, support, conflicts, audits.

All functions take the tables of :mod:`reportmill.operators.labelling`: ``rows`` is a supervision table,
``found`` its mentions, ``props`` its propositions, ``views`` the text views of the reports.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.functions import morphology as M
from reportmill.functions import text as X
from reportmill.functions import vocabulary as V
from reportmill.operators import relational as R

DEFAULT_MARKER = "<no_explicit_marker>"


def n_rows() -> Column:
    return F.count(F.lit(1)).alias("n")


def n_studies() -> Column:
    return F.count_distinct("study").alias("n_studies")


def evidence(rows: DataFrame) -> DataFrame:
    """One row per selected proposition with its place in the evidence of a study and target."""
    nested = rows.select("study", "target", "language_group", "report_sha256", "official_label", F.col("status").alias("final_status"), "rationale", F.posexplode("evidence_provenance").alias("place", "p"))
    kept = ("study", "target", "language_group", "report_sha256", "official_label", "final_status", "rationale", "place")
    wide = nested.select(*kept, "p.*")
    joined = lambda c: F.array_join(c, "+")
    return (
        wide.withColumn("winning", F.col("status") == F.col("final_status")).withColumn("normalized_evidence", X.normalize(F.col("evidence")))
        .withColumn("detector_combination", joined("detectors")).withColumn("rule_combination", F.when(F.size("rules") > 0, joined("rules")).otherwise("<no_explicit_rule>"))
        .withColumn("language_combination", joined("languages")).withColumn("view_support", support_scope(F.col("view_kinds"))).withColumn("source_clause_count", F.size("source_indices"))
        .withColumn("resolution_mode", resolution_mode(F.col("rationale")))
    )


def support_scope(kinds: Column) -> Column:
    """Which kinds of views support a proposition."""
    return X.let(F.array_sort(F.array_distinct(kinds)), lambda k: F.when(F.size(k) > 1, "strict_and_linked").when(F.array_contains(k, "linked"), "linked_only").when(F.array_contains(k, "strict"), "strict_only").otherwise("none"))


def resolution_mode(rationale: Column) -> Column:
    return F.when(rationale.contains("conflict"), "conflict").when(rationale.startswith("v3 collective"), "collective").when(rationale.startswith("no reliable"), "unresolved").otherwise("target_specific")


def phenotype(text: Column, status: Column, fallback: str = "abnormality") -> Column:
    """The first phenotype whose pattern the text has; negative statements get the fallback's absence."""
    out = F.when(status == "negative", F.lit(f"{fallback}_absent"))
    for name, pattern in M.PHENOTYPE_PATTERNS:
        out = out.when(text.rlike(f"(?U){pattern}"), F.lit(name))
    return out.otherwise(F.lit(fallback))


def rank_confidence(status: Column, detector: Column, collective: Column) -> Column:
    """Evidence-strength rank of a mention."""
    side = lambda s: F.when(collective, M.CONFIDENCE[f"collective_{s}"]).when(detector == "v2_exact", M.CONFIDENCE[f"exact_{s}"]).when(detector == "v3_morphology", M.CONFIDENCE[f"morphology_{s}"]).otherwise(M.CONFIDENCE[f"target_rule_{s}"])
    return F.when(status == "uncertain", M.CONFIDENCE["uncertain"] - F.when(collective, 0.05).otherwise(0.0)).when(status == "positive", side("positive")).otherwise(side("negative"))


def uncertainty_markers(text: Column) -> Column:
    """Sorted distinct wordings of uncertainty, or a default marker."""
    found = F.concat(F.regexp_extract_all(text, F.lit(X.term_pattern(V.UNCERTAINTY_TERMS)), F.lit(0)), F.regexp_extract_all(text, F.lit(f"(?U){M.UNCERTAINTY_PATTERN}"), F.lit(0)))
    return X.let(F.array_sort(F.array_distinct(found)), lambda x: F.when(F.size(x) > 0, x).otherwise(F.array(F.lit(DEFAULT_MARKER))))


def explicit_cue(target: str, clause: Column) -> Column:
    """Whether a clause names the target itself in any way a detector knows (a group it belongs to does not count)."""
    cue = X.contains_terms(clause, V.ANATOMY_TERMS.get(target, ()) + V.DIRECT_TERMS.get(target, ()))
    for pattern in [M.STRUCTURAL_ANATOMY_ROOTS.get(target), M.OA_ANATOMY_PATTERNS.get(target), *(r[4] for r in M.DIRECT_RULES if r[1] == target)]:
        if pattern:
            cue = cue | clause.rlike(f"(?U){pattern}")
    return cue


def negation_type(text: Column, spans: Column) -> Column:
    """How a negative statement is worded: the first negation that ends at most 90 characters before a finding or follows
    one within 40 as a postposed one decides, else normality, else any other negation."""
    later = X.term_pattern(V.POSTPOSED_NEGATION_TERMS)

    def kind(n: Column) -> Column:
        before = F.exists(spans, lambda f: (n["e"] <= f["s"]) & (f["s"] - n["e"] <= 90))
        behind = n["t"].rlike(f"^(?:{later})$") & F.exists(spans, lambda f: (n["s"] >= f["e"]) & (n["s"] - f["e"] <= 40))
        return F.when(before, F.lit("preposed")).when(behind, F.lit("postposed"))

    def worded(found: Column) -> Column:
        first = F.get(F.filter(F.transform(found, kind), lambda k: k.isNotNull()), F.lit(0))
        normal = X.normalize(text)
        rest = F.when(F.exists(F.array(*map(F.lit, V.NORMALITY_TERMS)), lambda t: F.contains(normal, t)), "explicit_normality").when(F.size(found) > 0, "other_implemented_negation")
        return F.coalesce(first, rest, F.lit("negative_status_without_reconstructed_marker"))

    return X.let(X.spans(text, X.term_pattern(V.NEGATION_TERMS)), worded)


# --- frames


def detector_counts(inventory: DataFrame) -> DataFrame:
    """Rows, studies and pairs of each detector, in total and by status and target."""
    rows = inventory.select("study", "target", "status", F.explode("detectors").alias("detector"))
    pairs = F.count_distinct("study", "target").alias("n_pairs")
    return R.grouping_sets(rows, ["detector", "status", "target"], [["detector"], ["detector", "status"], ["detector", "status", "target"]], n_rows(), n_studies(), pairs)


def confidence_by_dimension(inventory: DataFrame) -> DataFrame:
    """Confidence described along several dimensions at once."""
    dims = {"status": "status", "target": "target", "language": "language_group", "detectors": "detector_combination", "support": "view_support"}
    items = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(c).alias("value")) for k, c in dims.items()]))
    return R.describe(inventory.select("confidence", items.alias("d")).select("confidence", "d.*"), ["dimension", "value"], "confidence")


def phenotype_shares(inventory: DataFrame) -> DataFrame:
    return R.shares(inventory.groupBy("target", "status", "phenotype").agg(n_rows(), n_studies()), ["target", "status"])


def rule_shares(inventory: DataFrame) -> DataFrame:
    counts = inventory.select(F.explode_outer("rules").alias("rule")).na.fill("<no_explicit_rule>").groupBy("rule").agg(n_rows())
    return R.cumulative_share(counts, "n", [F.desc("n"), F.col("rule")])


def conflicts(rows: DataFrame, inventory: DataFrame) -> DataFrame:
    """Pairs resolved against other evidence, with the statuses and detectors on both sides."""
    kinds = inventory.groupBy("study", "target").agg(F.array_sort(F.collect_set("status")).alias("statuses"), F.array_sort(F.collect_set("detector_combination")).alias("detector_combinations"))
    return rows.where(F.col("rationale").contains("conflict")).select("study", "target", "status", "confidence", "rationale").join(kinds, ["study", "target"])


def collective_support(found: DataFrame, props: DataFrame) -> DataFrame:
    """Collective evidence as mentions and as propositions."""
    by = ["target", "status", "rule"]
    a = found.where("collective").groupBy(*by).agg(n_rows(), n_studies()).withColumn("unit", F.lit("mention"))
    b = props.where("collective").withColumn("rule", F.explode("rules")).groupBy(*by).agg(n_rows(), n_studies()).withColumn("unit", F.lit("proposition"))
    return a.unionByName(b)


def view_support(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("target", "status", "view_support").agg(n_rows(), n_studies())


def linked_only(inventory: DataFrame) -> DataFrame:
    """Pairs whose winning evidence rests on linked views alone."""
    held = inventory.where("winning").groupBy("study", "target").agg(F.array_sort(F.collect_set("view_support")).alias("supports"))
    return held.where(F.forall("supports", lambda s: s == "linked_only"))


def negations(inventory: DataFrame) -> DataFrame:
    rows = inventory.where("status = 'negative'").withColumn("negation", negation_type(F.col("evidence"), F.col("spans")))
    return rows.groupBy("target", "negation").agg(n_rows(), n_studies(), F.min_by("evidence", F.struct("study", "place")).alias("first_example"))


def uncertainties(inventory: DataFrame) -> DataFrame:
    rows = inventory.where("status = 'uncertain'").select("study", "target", F.explode(uncertainty_markers(F.col("evidence"))).alias("marker"))
    return rows.groupBy("target", "marker").agg(n_rows(), n_studies())


def clause_usage(clauses: DataFrame, found: DataFrame, inventory: DataFrame) -> DataFrame:
    """Clauses by what became of them: selected as evidence, mentioned only, or silent."""
    mark = lambda d, c: d.select("study", F.explode("source_indices").alias("idx")).distinct().withColumn(c, F.lit(True))
    rows = clauses.join(mark(inventory, "selected"), ["study", "idx"], "left").join(mark(found, "mentioned"), ["study", "idx"], "left")
    use = F.when(F.col("selected"), "selected").when(F.col("mentioned"), "mentioned").otherwise("silent")
    return rows.groupBy(use.alias("usage"), "diagnostic").agg(n_rows(), n_studies())


def unit_counts(reports: DataFrame, clauses: DataFrame, views: DataFrame, found: DataFrame, props: DataFrame) -> DataFrame:
    """Per unit of analysis the total and a description of its number per report (reports without any count as 0)."""
    total = None
    for name, df in {"clauses": clauses, "strict_views": views.where("kind = 'strict'"), "linked_views": views.where("kind = 'linked'"), "mentions": found, "propositions": props}.items():
        per = reports.select("study").join(df.groupBy("study").agg(n_rows()), "study", "left").select(F.lit(name).alias("unit"), F.coalesce("n", F.lit(0)).cast("double").alias("per_report"))
        total = per if total is None else total.unionByName(per)
    sums = total.groupBy("unit").agg(F.sum("per_report").cast("long").alias("total"))
    return R.describe(total, ["unit"], "per_report").join(sums, "unit")


def example_structure(inventory: DataFrame, families: DataFrame) -> DataFrame:
    """Winning evidence by target and status, counted at every unit at which examples may repeat."""
    rows = inventory.where("winning").join(families.select("study", "exact_family", "numeric_family"), "study")
    counts = rows.groupBy("target", "status").agg(
        n_rows(), F.count_distinct("normalized_evidence").alias("n_evidence"), n_studies(), F.count_distinct("exact_family").alias("n_exact_families"),
        F.count_distinct("numeric_family").alias("n_numeric_families"), F.array_sort(F.collect_set("language_group")).alias("languages"),
    )
    rules = F.when(F.size("rules") > 0, F.col("rules")).otherwise(F.array(F.lit("<no_explicit_rule>")))
    pairs = rows.select("target", "status", F.explode("detectors").alias("detector"), rules.alias("rules")).select("target", "status", "detector", F.explode("rules").alias("rule"))
    combined = pairs.groupBy("target", "status").agg(F.array_sort(F.collect_set(F.concat_ws("::", "detector", "rule"))).alias("detector_rules"))
    return counts.join(combined, ["target", "status"]).withColumn("n_detector_rules", F.size("detector_rules"))


def study_distribution(rows: DataFrame, props: DataFrame) -> DataFrame:
    """How targets by status, propositions and evidence texts are spread over studies: one row a measure."""
    s = F.col("status")
    per = rows.groupBy("study").agg(
        F.count_if(s.isin("positive", "negative")).alias("binary_resolved_targets"), *[F.count_if(s == x).alias(f"{x}_targets") for x in ("positive", "negative", "uncertain", "unknown")]
    )
    more = props.groupBy("study").agg(F.count(F.lit(1)).alias("propositions"), F.count_distinct("evidence").alias("unique_evidence_fragments"))
    wide = per.join(more, "study", "left").na.fill(0)
    items = F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("value")) for c in wide.columns if c != "study"]))
    return R.describe(wide.select(items.alias("m")).select("m.*"), ["measure"], "value")


def positive_misses(rows: DataFrame) -> DataFrame:
    """Official positives that no rule resolved: counts by language and target."""
    missed = rows.where((F.col("official_label") == 1) & F.col("status").isin("unknown", "uncertain"))
    return R.pivot_counts(missed.select("language_group", "target"), ["language_group"], "target", list(V.TARGETS))


def language_safety(rows: DataFrame) -> DataFrame:
    """What reading unknown as negative would cost, by language."""
    out = rows.where("status = 'unknown' AND official_label IS NOT NULL").groupBy("language_group").agg(F.count(F.lit(1)).alias("unknown_n"), F.sum("official_label").alias("false_negative"))
    return out.withColumn("correct_negative", F.col("unknown_n") - F.col("false_negative")).withColumn("safety", F.col("correct_negative") / F.col("unknown_n"))


def weight_sensitivity(rows: DataFrame, weights: tuple[float, ...] = (0.10, 0.25, 0.50, 1.00)) -> DataFrame:
    """Examples and false negatives that pseudo labels of several weights would add."""
    one = rows.where("status = 'unknown' AND official_label IS NOT NULL").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("official_label"), F.lit(0)).alias("bad"))
    out = one.select("n", "bad", F.explode(F.array(*map(F.lit, weights))).alias("weight"))
    return out.select("weight", (F.col("weight") * F.col("n")).alias("added_examples"), (F.col("weight") * F.col("bad")).alias("false_negative_mass"), F.try_divide("bad", "n").alias("incorrect_share"))


def audit(rows: DataFrame, views: DataFrame | None = None) -> DataFrame:
    """(check, issues): exhaustive consistency of labels, evidence and provenance, in one aggregation (and one join for membership)."""
    s, p = F.col("status"), F.col("evidence_provenance")
    conf = F.col("confidence")
    checks = {
        "positive_score": (s == "positive") & ~F.col("derived_score").eqNullSafe(1.0), "negative_score": (s == "negative") & ~F.col("derived_score").eqNullSafe(0.0),
        "unknown_is_empty": (s == "unknown") & ((F.size(p) > 0) | (conf != 0)), "resolved_has_evidence": (s != "unknown") & (F.size(p) == 0),
        "evidence_is_provenance": ~F.col("evidence").eqNullSafe(p["evidence"]), "first_evidence_wins": (s != "unknown") & (F.get(p, F.lit(0))["status"] != s),
        "at_most_three": F.size(p) > 3, "detectors_known": ~F.forall(F.flatten(p["detectors"]), lambda d: d.isin(*M.DETECTOR_PRIORITY)),
        "summary_fields": (F.size(F.array_except("phenotypes", p["phenotype"])) > 0) | (F.size(F.array_except("detectors", F.flatten(p["detectors"]))) > 0), "conflict_is_lower": F.col("rationale").contains("conflict") & (conf > F.array_max(p["confidence"]) - 0.05),
        "spans_in_text": F.exists(p, lambda x: F.exists(x["spans"], lambda k: (k["s"] < 0) | (k["e"] > F.length(x["evidence"])))),
    }
    row = rows.agg(*[F.count_if(bad).alias(c) for c, bad in checks.items()])
    out = row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("issues")) for c in checks])).alias("x")).select("x.*")
    if views is None:
        return out
    said = rows.select("study", F.explode(p["evidence"]).alias("text")).distinct()
    foreign = said.join(views.where("diagnostic").select("study", "text"), ["study", "text"], "left_anti").agg(F.lit("evidence_in_views").alias("check"), F.count(F.lit(1)).alias("issues"))
    return out.unionByName(foreign)


def frames(reports: DataFrame, leak: bool = False, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """All frames by name, lazily, over the given reports.

    ``keep`` takes the tables that many frames read (clauses, views, mentions, supervision) with a name, and gives them
    back as written, so that segmentation and detection run once.
    """
    from reportmill.operators import labelling as L
    from reportmill.operators import profile as P

    keep = keep or (lambda df, name: df)
    found, views, clauses = keep(L.mentions(reports, leak), "mentions"), keep(L.text_views(reports), "views"), keep(L.clauses(reports), "clauses")
    rows = keep(L.supervision(reports, "v3", found=found), "supervision")
    props, inventory = L.propositions(found), evidence(rows)
    texts = reports.select("study", "report").withColumn("normal", X.normalize(F.col("report")))
    return {
        "corpus_unit_counts": unit_counts(reports, clauses, views, found, props), "text_lengths": P.lengths(texts.withColumn("unit", F.lit("report")), ["unit"], "report"),
        "target_status": rows.groupBy("target", "status").agg(n_rows()), "study_status": R.pivot_counts(rows, ["study"], "status", ["positive", "negative", "uncertain", "unknown"]),
        "evidence_inventory": inventory, "detector_counts": detector_counts(inventory), "confidence": confidence_by_dimension(inventory), "phenotypes": phenotype_shares(inventory), "rules": rule_shares(inventory),
        "conflicts": conflicts(rows, inventory), "collective": collective_support(found, props), "view_support": view_support(inventory), "linked_only": linked_only(inventory), "negations": negations(inventory),
        "uncertainties": uncertainties(inventory), "clause_usage": clause_usage(clauses, found, inventory), "duplicates": P.duplicate_groups(texts, "study", "normal"), "duplicate_summary": P.duplicate_summary(texts, "normal"),
        "template_families": P.inconsistent_families(P.families(rows.join(reports.select("study", "report"), "study"), "report"), "exact_family", "target", "status"),
        "numeric_families": P.inconsistent_families(P.families(rows.join(reports.select("study", "report"), "study"), "report"), "numeric_family", "target", "status"),
        "unigrams": P.gram_counts(texts, "report", 1), "bigrams": P.gram_counts(texts, "report", 2), "audit": audit(rows, views),
        "effective_example_structure": example_structure(inventory, P.families(reports.select("study", "report"), "report")), "study_distribution": study_distribution(rows, props),
        "positive_misses": positive_misses(rows), "language_safety": language_safety(rows),
    }
