"""Evaluation: binary and multi-class metrics, intervals, confusion, aggregation of local labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRECEDENCE = {"positive": 3, "uncertain": 2, "negative": 1, "no_evidence": 0}


def binary_metrics(df: DataFrame, by: list[str], truth: Column, predicted: Column) -> DataFrame:
    """Counts and rates of 0/1 predictions; unresolved (null) predictions lower the coverage only. Empty rates are null."""
    cell = lambda t, p: F.count_if((truth == t) & (predicted == p))
    base = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(predicted.isNotNull()).alias("resolved"), cell(1, 1).alias("tp"), cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn")
    )
    rate = lambda a, b: F.try_divide(F.expr(a).cast("double"), F.expr(b))
    return base.select(
        "*", rate("resolved", "n").alias("coverage"), rate("tp", "tp + fp").alias("precision"), rate("tp", "tp + fn").alias("recall"),
        rate("2 * tp", "2 * tp + fp + fn").alias("f1"), rate("tn", "tn + fp").alias("specificity"),
    ).withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> Column:
    """struct<low,high> of the Wilson score interval; null without trials."""
    p = successes / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    below = 1 + z * z / n
    return F.when(n > 0, F.struct(((middle - spread) / below).alias("low"), ((middle + spread) / below).alias("high")))


def confusion(df: DataFrame, by: list[str], truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """A row for each true label and a column for each predicted one."""
    return df.groupBy(*by, F.col(truth).alias("truth")).agg(*[F.count_if(F.col(predicted) == x).alias(f"as_{x}") for x in labels])


def class_metrics(df: DataFrame, by: list[str], truth: str, predicted: str, labels: list[str]) -> DataFrame:
    """Precision, recall, F1 and support of each label, 0 where undefined, on a dense grid of labels."""
    pairs = df.select(*by, F.explode(F.array(*map(F.lit, labels))).alias("label"), F.col(truth).alias("t"), F.col(predicted).alias("p"))
    hit = pairs.groupBy(*by, "label").agg(
        F.count_if((F.col("t") == F.col("label")) & (F.col("p") == F.col("label"))).alias("tp"), F.count_if(F.col("p") == F.col("label")).alias("predicted"),
        F.count_if(F.col("t") == F.col("label")).alias("support"),
    )
    zero = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, n, s = F.col("tp"), F.col("predicted"), F.col("support")
    return hit.select(*by, "label", "support", zero(tp, n).alias("precision"), zero(tp, s).alias("recall"), zero(2 * tp, n + s).alias("f1"))


def averages(metrics: DataFrame, by: list[str]) -> DataFrame:
    """Macro averages over labels with support and averages weighted by support."""
    seen = F.col("support") > 0
    macro = [F.avg(F.when(seen, F.col(c))).alias(f"macro_{c}") for c in ("precision", "recall", "f1")]
    weighted = [F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"weighted_{c}") for c in ("precision", "recall", "f1")]
    return metrics.groupBy(*by).agg(F.sum("support").alias("n"), *macro, *weighted)


def aggregate_local(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """The status of a study from labels of its clauses: positive, else uncertain, else negative, else unknown."""
    place = F.create_map(*[F.lit(x) for kv in PRECEDENCE.items() for x in kv])
    top = F.max(F.element_at(place, F.col(label)))
    return df.groupBy(*keys).agg(
        F.when(top == 3, "positive").when(top == 2, "uncertain").when(top == 1, "negative").otherwise("unknown").alias("status"),
        F.count_if(F.col(label) != "no_evidence").alias("n_evidence"), F.count(F.lit(1)).alias("n_clauses"),
        ((F.count_if(F.col(label) == "positive") > 0) & (F.count_if(F.col(label) == "negative") > 0)).alias("conflict"),
    )


def log_lift(df: DataFrame, a: Column, n_a: Column, b: Column, n_b: Column) -> DataFrame:
    """Adds log2 of the smoothed ratio of two document frequencies."""
    return df.withColumn("lift", F.log2(((a + 1) / (n_a + 2)) / ((b + 1) / (n_b + 2))))
