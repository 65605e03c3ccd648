"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Each source gets a share of all sizes by weight. A share above ``cap`` times what the source has
stops there and the excess is shared again by weight among the others. A document of source s is
expected ``rate = target / source_size`` times. Documents of a source are put in order, their
expected copies are summed up, one random offset per source is added, and a document is emitted
once for every integer that its interval of the prefix sum crosses.

The order is by size (classes an eighth of an octave wide, then 256 hash buckets in a class), so
large and small documents are sampled alike and a source misses its target by about one document of
its largest size at most. Prefix sums are taken in three levels (source, class, bucket), so no task
sorts a whole source however hot it is.

Defined results: null or empty texts have size 0 and are emitted like any other; a null source is a
source of its own, after all others; a source of size 0 has target 0 and no copies; repeated rows
are separate documents, and equal rows may swap their copies; an empty table gives an empty table.
There is one row per source in the table of targets: weights are a setting of the mix, so the list
of sources is as long as what one configures.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.llm.common import col, documents, fresh, materialize, n_words

BUCKETS = 256


def targets(sources: DataFrame, source: str, size: str, weights: tuple[int, ...], cap: float, out: str) -> DataFrame:
    """Adds each source's target to a table of one row per source; keys are 's' and the name, or 'n' for the null source."""
    pos, weight, most, before, after, share = fresh(sources, "pos", "weight", "most", "before", "after", "share")
    everything = Window.partitionBy()
    by_name = everything.orderBy((col(source) == "n").asc(), col(source).asc())
    by_ratio = everything.orderBy((col(most) / col(weight)).asc(), col(pos).asc())
    first = F.min(F.when(col(most) / col(weight) > col(share), F.struct(col(before), col(share)))).over(everything)
    return (
        sources.withColumn(pos, F.row_number().over(by_name))
        .withColumn(weight, F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((col(pos) - 1) % len(weights) + 1).cast("int")))
        .withColumn(most, col(size) * F.lit(float(cap)))
        .withColumn(before, F.coalesce(F.sum(most).over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn(after, F.sum(weight).over(by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
        .withColumn(share, (F.sum(size).over(everything).cast("double") - col(before)) / col(after))
        .withColumn(share, first[share])
        .withColumn(out, F.coalesce(F.least(col(most), col(weight) * col(share)), col(most)))
        .drop(pos, weight, most, before, after, share)
    )


def _hash12(c: Column) -> Column:
    """48 bits of an MD5 as a long."""
    return F.conv(F.substring(F.md5(c), 1, 12), 16, 10).cast("long")


def assign_copies(
    df: DataFrame, *, size: str, key: str = "doc_id", source: str = "source", weights: tuple[int, ...] = (1, 2, 3),
    cap: float = 3.0, seed: int = 42, names: tuple[str, str, str] = ("source_size", "target", "copies"),
) -> DataFrame:
    """Adds the size of a row's source, that source's target and how many copies of the row the mix takes."""
    source_size, target, copies = fresh(df, *names)
    cls, bucket, order, n, in_cls, in_src, rank, src = fresh(df, "cls", "bucket", "order", "n_rows", "in_cls", "in_src", "rank", "src")
    s1, c1, b1, z1, t1, s2, c2 = fresh(df, "s1", "c1", "b1", "z1", "t1", "s2", "c2")
    bits = F.length(F.bin(col(size) + 1))
    v = f"(`{size}` + 1)"
    b = f"length(bin({v}))"
    eighth = F.expr(f"CASE WHEN {b} >= 4 THEN shiftright({v}, {b} - 4) ELSE shiftleft({v}, 4 - {b}) END").bitwiseAND(7)
    # a key that is never null, so that the window's partitioning serves the join as well
    rows = (
        df.withColumn(src, F.coalesce(F.concat(F.lit("s"), col(source).cast("string")), F.lit("n"))).withColumn(order, _hash12(F.coalesce(col(key).cast("string"), F.lit("null"))))
        .withColumn(cls, (bits * 8 + eighth).cast("int"))
        .withColumn(bucket, F.shiftright(col(order), 40).cast("int"))
    )
    cells = rows.groupBy(col(src), col(cls), col(bucket)).agg(F.count(F.lit(1)).alias(n), F.sum(size).alias(size))
    classes = cells.groupBy(col(src), col(cls)).agg(F.sum(n).alias(n), F.sum(size).alias(size))
    sources = classes.groupBy(col(src)).agg(F.sum(size).alias(source_size))
    earlier = (Window.unboundedPreceding, -1)
    in_class = cells.select(
        col(src).alias(s1), col(cls).alias(c1), col(bucket).alias(b1),
        F.coalesce(F.sum(n).over(Window.partitionBy(src, cls).orderBy(bucket).rowsBetween(*earlier)), F.lit(0)).alias(in_cls),
    )
    in_source = classes.select(
        col(src).alias(s2), col(cls).alias(c2),
        F.coalesce(F.sum(n).over(Window.partitionBy(src).orderBy(cls).rowsBetween(*earlier)), F.lit(0)).alias(in_src),
    )
    goal = targets(sources, src, source_size, weights, cap, target).withColumnRenamed(src, s2)
    starts = in_source.join(goal, s2).select(
        col(s2), col(c2), col(in_src), col(source_size), col(target)
    )
    cell_starts = in_class.join(starts, (col(s1) == col(s2)) & (col(c1) == col(c2))).select(
        col(s1), col(c1), col(b1), (col(in_cls) + col(in_src)).alias(in_src), col(source_size).alias(z1), col(target).alias(t1)
    )
    within = Window.partitionBy(src, cls, bucket).orderBy(col(size), col(order), col(key))
    numbered = rows.withColumn(rank, F.row_number().over(within) - 1)
    rate = F.when(col(z1) > 0, col(t1) / col(z1)).otherwise(F.lit(0.0))
    offset = _hash12(F.concat(F.lit(f"{seed}|"), col(src))) / F.lit(float(1 << 48))
    k = col(rank) + col(in_src)
    crossed = F.floor((k + 1) * rate + offset) - F.floor(k * rate + offset)
    joined = numbered.join(
        cell_starts, (col(src) == col(s1)) & (col(cls) == col(c1)) & (col(bucket) == col(b1))
    )
    return joined.select(
        *[numbered[f"`{c}`"] for c in df.columns],
        col(z1).alias(source_size), col(t1).alias(target),
        F.least(crossed, F.ceil(rate)).cast("long").alias(copies),
    )


def mix(docs: DataFrame, *, text: str = "text", **options) -> DataFrame:
    """The mixed corpus: the columns of the input, each document as often as the mix takes it."""
    size, copies = fresh(docs, "mix_size", "mix_copies")
    sized = docs.withColumn(size, n_words(col(text)))
    names = fresh(sized, "mix_source_size", "mix_target", copies)
    counted = assign_copies(sized, size=size, names=tuple(names), **options)
    again = fresh(counted, "mix_no")[0]
    return (
        counted.where(col(names[2]) > 0)
        .withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), col(names[2]))))
        .select(*[col(c) for c in docs.columns])
    )


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    sized = documents(spark, sf_dir).select("doc_id", "source", n_words(F.col("text")).alias("size"))
    sized = materialize(sized, "mix-sizes")  # a few bytes a row, read three times; texts are read once
    return assign_copies(sized, size="size").select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) AS ord
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w,
         row_number() OVER (ORDER BY source ASC NULLS LAST) AS pos, source_size * 3.0::DOUBLE AS most FROM src),
shared AS (
  SELECT *, (sum(CAST(source_size AS DOUBLE)) OVER () - coalesce(sum(most) OVER (ORDER BY most / w, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY most / w, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share,
         row_number() OVER (ORDER BY most / w, pos) AS spot FROM weighed),
goal AS (
  SELECT source, source_size,
         coalesce(least(most, w * (SELECT arg_min(share, spot) FROM shared WHERE most / w > share)), most) AS target,
         CAST('0x' || substr(md5('42|' || coalesce('s' || source, 'n')), 1, 12) AS BIGINT) / 281474976710656.0::DOUBLE AS u
  FROM shared),
classed AS (
  SELECT *, length(bin(size + 1)) AS b FROM sized),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY
      b * 8 + ((CASE WHEN b >= 4 THEN (size + 1) >> (b - 4) ELSE (size + 1) << (4 - b) END) & 7),
      ord >> 40, size, ord, doc_id) - 1 AS k FROM classed),
rated AS (
  SELECT o.doc_id, o.size, g.source_size, g.target, o.k, g.u,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS r
  FROM ordered o JOIN goal g ON o.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(least(floor((k + 1) * r + u) - floor(k * r + u), ceil(r)) * size AS BIGINT) AS taken
FROM rated
"""
