"""Relational operators of the analytics suite: grids, grouping sets, statistics, ranks, samples, sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def complete_grid(facts: DataFrame, rows: DataFrame, columns: DataFrame, fill: dict[str, object]) -> DataFrame:
    """Every combination of two dimensions with what is known of it. ``columns`` is a closed domain (a few rows)."""
    keys = [*rows.columns, *columns.columns]
    return rows.crossJoin(F.broadcast(columns)).join(facts, keys, "left").na.fill(fill)


def grouping_sets(df: DataFrame, dims: list[str], sets: list[list[str]], *aggs: Column) -> DataFrame:
    """Aggregates of several groupings in one pass; ``level`` names the grouping of a row."""
    done = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims]).agg(F.grouping_id().alias("gid"), *aggs)
    names = {sum(1 << (len(dims) - 1 - i) for i, d in enumerate(dims) if d not in s): "+".join(s) or "all" for s in sets}
    level = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return done.withColumn("level", F.element_at(level, F.col("gid").cast("int"))).drop("gid")


PERCENTS = {"p05": 0.05, "p25": 0.25, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count, mean, sample deviation, median, extremes and exact percentiles."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.percentile(v, F.lit(0.5)).alias("median"), F.min(v).alias("min"),
        F.max(v).alias("max"), *[F.percentile(v, F.lit(p)).alias(n) for n, p in PERCENTS.items()],
    )


def population(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Population variance and deviation with P25 to P99."""
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.count(v).alias("n"), F.var_pop(v).alias("variance"), F.stddev_pop(v).alias("sd"),
        *[F.percentile(v, F.lit(p)).alias(n) for n, p in {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}.items()],
    )


def first_per_group(df: DataFrame, by: list[str], *order) -> DataFrame:
    """The first row of each group in an order."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_rank = 1").drop("_rank")


def heads_then_rest(df: DataFrame, by: list[str], order: list[Column], limit: int) -> DataFrame:
    """First the head of every group, then the others, up to a number of rows (the feature is the limit)."""
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return ranked.withColumn("is_head", F.col("turn") == 1).orderBy(F.col("is_head").desc(), *order).limit(limit).drop("turn")


def top_per_group(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def hash_order(key: Column, seed: int) -> Column:
    """A reproducible random order."""
    return F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256)


def hash_sample(df: DataFrame, key: str, seed: int, n: int) -> DataFrame:
    """The n rows that come first by hash (n is the feature)."""
    return df.withColumn("order_hash", hash_order(F.col(key), seed)).orderBy("order_hash").limit(n)


def stratified_sample(df: DataFrame, strata: list[str], key: str, seed: int, per_stratum: int, n: int) -> DataFrame:
    """A few rows of each stratum by hash, then the first n of those."""
    hashed = df.withColumn("order_hash", hash_order(F.col(key), seed))
    return top_per_group(hashed, strata, [F.col("order_hash")], per_stratum, "stratum_rank").orderBy("order_hash").limit(n)


def cumulative_share(counts: DataFrame, n: str, order: list[Column]) -> DataFrame:
    """Share and running share of counts. One row per category: the ordering is over categories, not over facts."""
    everything = Window.partitionBy()
    running = everything.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(n).over(everything)
    return counts.withColumn("share", F.col(n) / total).withColumn("cumulative_share", F.sum(n).over(running) / total)


def transitions(before: DataFrame, after: DataFrame, keys: list[str], value: str, by: list[str]) -> DataFrame:
    """How often a value went from what to what between two versions of a table with unique keys."""
    old = before.select(*keys, F.col(value).alias(f"{value}_old"))
    new = after.select(*keys, F.col(value).alias(f"{value}_new"))
    return old.join(new, keys).groupBy(*by, f"{value}_old", f"{value}_new").agg(F.count(F.lit(1)).alias("n"))


def shares(df: DataFrame, within: list[str], n: str = "n") -> DataFrame:
    return df.withColumn("share", F.col(n) / F.sum(n).over(Window.partitionBy(*within)))


def pivot_counts(df: DataFrame, by: list[str], column: str, values: list[str]) -> DataFrame:
    """A count for each of a closed list of values; absent ones are 0."""
    return df.groupBy(*by).agg(*[F.count_if(F.col(column) == v).alias(v) for v in values])


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_left, only_right): rows, with repeats, that only one of two frames has. Columns are matched by position.

    Texts and bytes are compared by their SHA-256, so that no long value is dealt or held; null stays null.
    """
    texts = (T.StringType(), T.BinaryType())
    long = [x.dataType in texts and x.dataType == y.dataType for x, y in zip(a.schema, b.schema, strict=True)]
    keys = [f"k{i}" for i in range(len(long))]

    def counted(d: DataFrame, sign: int) -> DataFrame:
        # Each side is grouped before the union: there Spark leaves out a sort of that side, which deals all rows anew.
        key = [F.unhex(F.sha2(F.col(k).cast("binary"), 256)).alias(k) if x else F.col(k) for k, x in zip(keys, long, strict=True)]
        return d.toDF(*keys).select(*key).groupBy(*keys).agg((F.count(F.lit(1)) * sign).alias("n"))

    more = counted(a, 1).union(counted(b, -1)).groupBy(*keys).agg(F.sum("n").alias("n"))  # of the left side
    total = lambda n: F.coalesce(F.sum(F.greatest(F.lit(0), n)), F.lit(0))
    return more.agg(total(F.col("n")).alias("only_left"), total(-F.col("n")).alias("only_right"))


def null_profile(df: DataFrame) -> DataFrame:
    """(column, n_rows, n_null, n_distinct) of every column, in one aggregation."""
    cols = df.columns
    row = df.agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"null_{i}") for i, c in enumerate(cols)],
        *[F.count_distinct(F.col(f"`{c}`")).alias(f"distinct_{i}") for i, c in enumerate(cols)],
    )
    items = F.array(*[F.struct(F.lit(c).alias("column"), F.col("n_rows"), F.col(f"null_{i}").alias("n_null"), F.col(f"distinct_{i}").alias("n_distinct")) for i, c in enumerate(cols)])
    return row.select(F.explode(items).alias("x")).select("x.*")


def capped_weights(df: DataFrame, by: list[str], cap: float) -> DataFrame:
    """1 / sqrt(group size), at most cap times the least weight."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("group_size"))
    raw = 1 / F.sqrt("group_size")
    floor = sizes.agg(F.min(raw).alias("least"))  # one row
    limited = sizes.join(F.broadcast(floor)).select(*by, F.least(raw, F.col("least") * cap).alias("weight"))
    return df.join(limited, by)
