"""Whole runs from a table of reports to written results, and their command line.

``python -m reportmill.plans.runs label|inspect|prepare --reports PATH --out PATH [--policy v2|v3]``
"""

from __future__ import annotations

import argparse
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.functions import text as X
from reportmill.operators import inspection as I
from reportmill.operators import labelling as L
from reportmill.operators import profile as P
from reportmill.operators import relational as R
from reportmill.operators import training as T
from reportmill.plans.shipping import ship
from reportmill.sources.sinks import write_frames, write_table


@dataclass(frozen=True)
class Parameters:
    """Settings of the inspection and of training sets."""

    seed: int = 20260817
    audit_rows: int = 600
    pair_texts: int = 200
    split_seed: int = 20260818
    weight_cap: float = 4.0

    def as_dict(self) -> dict:
        return asdict(self)


def checked(violations: DataFrame) -> None:
    """Raises if any check has violations (a handful of rows)."""
    bad = [(r[0], r[1]) for r in violations.collect() if r[1]]
    if bad:
        raise ValueError(f"violations: {bad}")


def label(spark: SparkSession, reports: DataFrame, out: str, policy: str = "v3", leak: bool = False) -> DataFrame:
    """Writes the supervision table with its summaries and audit; gives the table as written."""
    ship(spark)
    checked(L.input_violations(reports))
    write_table(L.supervision(reports, policy, leak), f"{out}/supervision")
    rows = spark.read.parquet(f"{out}/supervision")
    checked(L.output_violations(rows))
    coverage = R.grouping_sets(rows, ["target", "language_group"], [["target"], ["language_group"], ["target", "language_group"]], F.count(F.lit(1)).alias("n"),
                               F.avg(F.when(F.col("status").isin("positive", "negative"), 1.0).otherwise(0.0)).alias("coverage"))
    write_frames({"status": rows.groupBy("target", "status").agg(F.count(F.lit(1)).alias("n")), "coverage": coverage}, f"{out}/summaries")
    return rows


def inspect(spark: SparkSession, reports: DataFrame, out: str, p: Parameters = Parameters()) -> list[str]:
    """Writes all inspection frames, a stratified audit sample and a similarity sample; gives their names."""
    ship(spark)

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{out}/_tables/{name}")
        return spark.read.parquet(f"{out}/_tables/{name}")

    frames = I.frames(reports, keep=keep)
    inventory = frames["evidence_inventory"]
    keyed = inventory.withColumn("key", F.concat_ws(":", "study", "target", "place"))
    frames["audit_sample"] = R.stratified_sample(keyed, ["target", "status", "language_group"], "key", p.seed, 1, p.audit_rows)
    similar = P.sampled_pairs(reports, "study", "report", p.seed, p.pair_texts).withColumn("all", F.lit("pairs"))
    frames["similarity"] = R.describe(similar, ["all"], "similarity")
    write_frames(frames, out)
    checked(spark.read.parquet(f"{out}/audit"))
    return sorted(frames)


def prepare(spark: SparkSession, reports: DataFrame, out: str, p: Parameters = Parameters()) -> DataFrame:
    """Writes local training examples with grouped splits, weights and novelty of the test rows; gives the counts."""
    ship(spark)
    unlabelled = L.official_labels(reports).groupBy("study").agg(F.count("official_label").alias("k")).where("k = 0").select("study")
    open_reports = reports.join(unlabelled, "study", "left_semi")
    write_table(L.mentions(open_reports), f"{out}/mentions")
    found = spark.read.parquet(f"{out}/mentions")
    inventory = I.evidence(L.supervision(open_reports, found=found))
    usable = T.candidates(inventory, T.surface_clauses(open_reports))
    write_table(usable, f"{out}/candidates")
    usable = spark.read.parquet(f"{out}/candidates").where("failure IS NULL")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    write_table(T.contrastive(T.safe_targets(usable, T.guard_keys(found)), p.seed, parts), f"{out}/contrastive")
    negatives = spark.read.parquet(f"{out}/contrastive").where("target IS NOT NULL")
    units = T.collapse(usable.withColumnRenamed("raw", "clause"), ["study", "target", "idx", "clause", "status"])
    constructed = negatives.select("study", "target", "idx", "clause", F.lit("no_evidence").alias("status"), F.array(F.lit("contrastive_other_target")).alias("detectors"), F.lit(None).cast("double").alias("confidence"), F.lit(1).cast("long").alias("n_merged"))
    units = units.unionByName(constructed)
    families = P.families(open_reports.select("study", "report"), "report").withColumn("language_group", X.language_group(X.normalize(F.col("report"))))
    write_table(T.assign_splits(families.select("study", "numeric_family", "language_group"), "study", "numeric_family", ["language_group"], p.split_seed), f"{out}/splits")
    splits = spark.read.parquet(f"{out}/splits")
    checked(T.leaks(splits, ["split_group", "numeric_family"]))
    rows = units.join(splits.select("study", "split"), "study").withColumn("order", F.concat_ws(":", "study", "idx"))
    train, _ = T.training_dedup(rows.where("split = 'train'"), "target", "clause", "status", "order")
    weighted = R.capped_weights(train, ["target", "status"], p.weight_cap)
    test = T.novelty(rows.where("split = 'test'"), train, ["target", "clause"])
    write_frames({"train": weighted, "validation": rows.where("split = 'validation'"), "test": test}, out)
    return rows.groupBy("split", "target", "status").agg(F.count(F.lit(1)).alias("n"))


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("run", choices=["label", "inspect", "prepare"])
    parser.add_argument("--reports", required=True, help="Parquet with study, report and 12 nullable labels")
    parser.add_argument("--out", required=True)
    parser.add_argument("--policy", choices=["v2", "v3"], default="v3")
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    reports = spark.read.parquet(a.reports)
    if a.run == "label":
        label(spark, reports, a.out, a.policy)
    else:
        {"inspect": inspect, "prepare": prepare}[a.run](spark, reports, a.out)


if __name__ == "__main__":
    main()
