"""Sharding by vector bin packing: bytes, tokens and rows of all shards are balanced together.

Equal texts form a group. A group that is more than 1/768 of all bytes, tokens or rows is an item of
its own (so there are at most 3 x 768 such groups), cut into pieces of at most a quarter of a shard;
all other groups go by a hash of their text into 4,096 bundles. The items, a bounded number whatever
the corpus size, are packed by the driver: largest first, each into the shard where the dot product
of its (bytes, tokens, rows) with what is still free there is highest. Everything that grows with the
corpus is done by aggregations and joins with these bounded tables.

Defined results: a null text has no bytes and counts as a group of its own; repeated rows are separate
rows of one group; an empty table gives an empty table. A single text longer than a shard makes that
shard larger, as documents are not cut.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportmill.llm.common import col, documents, fresh, materialize, n_words

SHARDS = 24
BUNDLES = 4096
#: A group above this part of a shard is an item of its own.
LARGE = 1 / 32
#: A piece of a group is at most this part of a shard.
PIECE = 1 / 4
DIMENSIONS = ("bytes", "tokens", "rows")


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item (rows of sizes by dimension)."""
    if not len(items):
        return np.zeros(0, int)
    totals = np.maximum(items.sum(axis=0), 1e-12)
    parts = items / totals * shards  # sizes in shards
    free = np.ones((shards, items.shape[1]))
    out = np.zeros(len(items), int)
    for i in np.lexsort((np.arange(len(items)), -parts.max(axis=1))):
        fits = (free >= parts[i] - 1e-9).all(axis=1)
        value = free @ parts[i]
        out[i] = int(np.argmax(np.where(fits, value, value.min() - 1 - (parts[i] - free).max(axis=1)) if fits.any() else -(parts[i] - free).max(axis=1)))
        free[out[i]] -= parts[i]
    return out


def assign(rows: DataFrame, *, key: str, group: list[str], size: str, tokens: str, shards: int = SHARDS, name: str = "shard") -> DataFrame:
    """Adds the shard of each row. ``group`` names the columns that make rows one group."""
    (out,) = fresh(rows, name)
    gh = F.xxhash64(*[col(c) for c in group])
    sums = [F.sum(size).alias("bytes"), F.sum(tokens).alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = rows.agg(*sums).first()
    if not total["rows"]:
        return rows.withColumn(out, F.lit(0))
    limit = {d: max(1.0, (total[d] or 0) / shards * LARGE) for d in DIMENSIONS}
    groups = rows.groupBy(*[col(c).alias(f"g{i}") for i, c in enumerate(group)]).agg(*sums)
    parts = F.greatest(*[F.ceil(F.col(d) / (max(1.0, (total[d] or 0) / shards * PIECE))) for d in DIMENSIONS]).cast("int")
    over = F.lit(False)
    for d in DIMENSIONS:
        over = over | (F.col(d) > limit[d])
    keys = [f"g{i}" for i in range(len(group))]
    # at most 3 * shards / LARGE groups exceed a limit; the table is kept, so that it is made once
    large = materialize(groups.where(over).select(*keys, parts.alias("pieces"), F.xxhash64(*keys).alias("gh")), "large-groups")
    named = fresh(rows, "item", "piece_count", "large_hash")
    small = large.select(*keys, F.col("pieces").alias(named[1]), F.col("gh").alias(named[2]))
    same = F.lit(True)
    for c, k in zip(group, keys, strict=True):
        same = same & col(c).eqNullSafe(F.col(k))
    tagged = rows.join(F.broadcast(small), same, "left").drop(*keys)
    piece = F.pmod(F.xxhash64(col(key), col(size)), col(named[1]))
    item = F.when(col(named[1]).isNull(), F.concat(F.lit("b"), F.pmod(gh, F.lit(BUNDLES)))).otherwise(F.concat_ws("|", F.lit("g"), col(named[2]).cast("string"), piece.cast("string")))
    tagged = tagged.withColumn(named[0], item).drop(named[1], named[2])
    # at most BUNDLES rows and the pieces of the large groups
    items = tagged.groupBy(col(named[0]).alias("item")).agg(*sums).orderBy("item").collect()
    where = pack(np.array([[r[d] or 0 for d in DIMENSIONS] for r in items], float), shards)
    placed = rows.sparkSession.createDataFrame([(r["item"], int(s)) for r, s in zip(items, where, strict=True)], "item string, placed int")
    placed = placed.select(F.col("item").alias("item_key"), F.col("placed").alias(out))
    return tagged.join(F.broadcast(placed), col(named[0]) == F.col("item_key")).select(*[col(c) for c in rows.columns], col(out))


def with_slots(rows: DataFrame, *, key: str, shard: str, name: str = "slot", buckets: int = 1024) -> DataFrame:
    """Adds gapless numbers from 0 within each shard: buckets by hash of the key, then places in the bucket."""
    out, bucket, before, at = fresh(rows, name, "bucket", "before", "place")
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(*[col(c) for c in rows.columns]), F.lit(buckets)))
    counts = rows.groupBy(col(shard).alias("s"), col(bucket).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select(
        "s", "b", F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before)
    )
    numbered = rows.withColumn(at, F.row_number().over(Window.partitionBy(shard, bucket).orderBy(col(key))) - 1)
    # at most shards * buckets rows
    joined = numbered.join(F.broadcast(starts), (col(shard) == F.col("s")) & (col(bucket) == F.col("b")))
    return joined.withColumn(out, (col(before) + col(at)).cast("long")).drop("s", "b", bucket, before, at)


def shard(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """(key, size, text_crc32, shard, slot) of every document."""
    t = col(text)
    body = F.coalesce(t, F.lit(""))
    rows = docs.select(
        col(key), (F.octet_length(body) + 8).cast("long").alias("size"), n_words(t).alias("tokens"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"), F.xxhash64(t).alias("text_hash"), t.isNull().alias("no_text"),
    )
    rows = materialize(rows, "shard-rows")
    placed = assign(rows, key=key, group=["text_hash", "text_crc32", "size", "no_text"], size="size", tokens="tokens", shards=shards)
    return with_slots(placed, key=key, shard="shard").select(key, "size", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, *, text: str = "text", key: str = "doc_id", shards: int = SHARDS) -> None:
    """Writes the documents as one folder per shard; rows with equal keys go where their own texts belong."""
    placed = shard(docs.select(key, text), text=text, key=key, shards=shards)
    where = placed.select(col(key).alias("k"), "text_crc32", "size", "shard").distinct()
    body = F.coalesce(col(text), F.lit(""))
    joined = docs.join(where, col(key).eqNullSafe(F.col("k")) & (F.crc32(F.encode(body, "UTF-8")) == F.col("text_crc32")) & (F.octet_length(body) + 8 == F.col("size")))
    joined.select(*[col(c) for c in docs.columns], F.col("shard").alias("shard_no")).write.partitionBy("shard_no").parquet(path)


def op8_sharding(spark, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
