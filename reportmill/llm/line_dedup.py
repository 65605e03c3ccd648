"""Line dedup across documents by a segment-partition edit join.

Lines of at least ``MIN_CHARS`` characters are compared. Equal lines are one class. Two classes link when
their edit distance is at most ``DISTANCE`` (2). A line is cut into three (distance + 1) segments whose
hashes, with length and segment number, are the index. Lines at least as long look up their own
substrings at the places where an equal segment of a linked line can begin (multi-match aware: a
segment is moved by at most what the errors before and after it allow), for each length the distance
allows. Two linked lines share at least one such key. What shares a key is verified: first by counts
of characters in 8 classes, then by a bit-parallel edit distance.

Shorter lines, of at least ``EXACT_CHARS`` characters, are compared for equality only (two edits make another
short line of many a short line); lines shorter than that are words and numbers that recur by themselves.

An occurrence is a duplicate, and goes, when its class, or a class linked with it, occurs earlier (by document
id, null last, then line), in another document or in its own.

A step of document-level dedup after this one wants copies whole. For that, and only where asked for,
``copy_share`` exempts copies: where a single earlier document holds more than that share of a document's
characters, the document's lines from there stay, so that the next step can judge the copy (and finds it
equal to the original, which loses the same other lines). With ``similarity`` that is only so where the
document-level criterion holds: what stays of the document and of that earlier one has at least this
Jaccard coefficient of sets of ``words`` word shingles. All other documents lose their duplicate lines, and
repeats inside a document always go.

Equal lines count once before anything is compared. A key with many classes is cut into blocks, and a
pair of blocks returns for each class only its earliest linked class, so no task gets a whole key and
no pairs are listed. Texts travel only for lines that share a key; a bit map of fixed size picks them.

Defined results: null texts stay null, blank lines (nothing but ASCII white space) stay, documents keep their
other columns, whatever their names; texts and lines are read whole however long;
rows with equal id and text are one document to this operator and get equal results; an empty table
gives an empty table.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.llm.common import WHITE, col, documents, fresh, let, materialize
from reportmill.llm.components import _join
from reportmill.llm.simhash import shingles

MIN_CHARS = 30
#: Shorter lines than MIN_CHARS, down to this length, are duplicates only when they are equal.
EXACT_CHARS = 12
DISTANCE = 2
#: Shingle width of the document-level criterion for what counts as a copy.
COPY_WORDS = 5
BLOCK = 512
#: Bits of the maps that pick lines and documents before they are dealt: 1 MB each.
MAP_BITS = 1 << 23


def signed(h: int) -> int:
    return h - (1 << 64) if h >> 63 else h


def line_hash(line: str) -> int:
    """The same number as :func:`class_hash`."""
    return signed(xxhash.xxh64_intdigest(line.encode("utf-8", "surrogatepass"), 42)) & ~1


def class_hash(line: Column) -> Column:
    """63 bits of a line's hash; the lowest bit is free to mark probes."""
    return F.xxhash64(line).bitwiseAND(F.lit(~1))


def blank(line: str) -> bool:
    """Whether a line holds nothing but ASCII white space, as the patterns of the tables test it."""
    return not line.strip(WHITE)


def segments(length: int, tau: int = DISTANCE) -> list[tuple[int, int]]:
    """(start, length) of tau + 1 segments of nearly even length, shorter ones first."""
    short, longer = divmod(length, tau + 1)
    out, at = [], 0
    for i in range(tau + 1):
        n = short + (i >= tau + 1 - longer)
        out.append((at, n))
        at += n
    return out


@lru_cache(maxsize=65536)
def places(n: int, tau: int = DISTANCE) -> tuple[tuple[tuple[int, int, int], ...], tuple[tuple[int, int, int], ...]]:
    """(seed, start, end) of the index segments and of the probed substrings of a line of n characters."""
    index = tuple((n * (tau + 1) + i, at, at + size) for i, (at, size) in enumerate(segments(n, tau)))
    probes = []
    for length in range(max(n - tau, tau + 1), n + 1):
        delta = n - length
        for i, (at, size) in enumerate(segments(length, tau)):
            low = max(0, at - i, at + delta - (tau - i))
            high = min(n - size, at + i, at + delta + (tau - i))
            probes += [(length * (tau + 1) + i, p, p + size) for p in range(low, high + 1) if delta or p != at]
    return index, tuple(probes)  # a line's own segments are index keys already


def keys(line: str, tau: int = DISTANCE) -> tuple[list[int], list[int]]:
    """(index keys, probe keys) of a line, unsigned."""
    index, probes = places(len(line), tau)
    digest = xxhash.xxh64_intdigest
    raw = line.encode("utf-8", "surrogatepass")
    if len(raw) == len(line):
        return [digest(raw[a:b], s) for s, a, b in index], [digest(raw[a:b], s) for s, a, b in probes]
    part = lambda s, a, b: digest(line[a:b].encode("utf-8", "surrogatepass"), s)
    return [part(*x) for x in index], [part(*x) for x in probes]


def _plain(a: str, b: str) -> int:
    row = list(range(len(a) + 1))
    for j, c in enumerate(b, 1):
        diagonal, row[0] = row[0], j
        for i, x in enumerate(a, 1):
            diagonal, row[i] = row[i], min(diagonal + (x != c), row[i] + 1, row[i - 1] + 1)
    return row[-1]


def within(a: str, b: str, tau: int = DISTANCE) -> bool:
    """Whether the edit distance is at most tau: bit-parallel columns of a band along the diagonal."""
    if abs(len(a) - len(b)) > tau:
        return False
    start, most = 0, min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    end = 0
    while end < most - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    n, m = len(a), len(b)
    if not n or not m:
        return max(n, m) <= tau
    if min(n, m) <= tau:
        return _plain(a, b) <= tau
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    # bit width - 1 of the band is row j + tau of column j, until the last row is reached
    width = 2 * tau + 2
    full, top = (1 << width) - 1, width - 1
    plus, minus, score, limit = (full << (width - tau - 1)) & full, 0, tau, 3 * tau + m - n
    for j, c in enumerate(b):
        shift, rows = j + tau + 1 - width, where.get(c, 0)
        x = (rows >> shift if shift >= 0 else rows << -shift) & full
        d = ((((x & plus) + plus) ^ plus) | x | minus) & full
        up, down = minus | (~(d | plus) & full), d & plus
        if j < n - tau:
            score += not d >> top & 1
        else:
            bit = 1 << (width - 2 - (j - (n - tau)))
            score += bool(up & bit) - bool(down & bit)
        if score > limit:
            return False
        plus, minus = (down | (~((d >> 1) | up) & full)), (d >> 1) & up
    return score <= tau


def character_counts(line: str) -> np.ndarray:
    """Counts of characters in 8 classes; tau edits change their sum of differences by 2 tau at most."""
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.bincount((points * np.uint32(2654435761) >> np.uint32(29)).astype(int), minlength=8)


#: Up to so many different lines of a text are compared one by one, more by their keys.
FEW_LINES = 64


def repeats(text: str, min_chars: int = MIN_CHARS, tau: int = DISTANCE) -> list[int]:
    """Numbers of the compared lines that an equal or linked line stands before in the same text."""
    lines = [(k, x) for k, x in enumerate(text.split("\n")) if len(x) >= min(EXACT_CHARS, min_chars) and not blank(x)]
    if len(lines) < 2:
        return []
    few = len({x for _, x in lines if len(x) >= min_chars}) <= FEW_LINES
    out, known, by_length, indexed, probed = [], set(), {}, {}, {}
    for k, x in lines:
        if x in known:
            out.append(k)
            continue
        if len(x) < min_chars:
            near = []
        elif few:
            near = [y for n in range(len(x) - tau, len(x) + tau + 1) for y in by_length.get(n, ())]
            by_length.setdefault(len(x), []).append(x)
        else:
            index, probes = keys(x, tau)
            near = dict.fromkeys(y for key in index + probes for y in indexed.get(key, ()))
            near |= dict.fromkeys(y for key in index for y in probed.get(key, ()))
            for key in index:
                indexed.setdefault(key, []).append(x)
            for key in probes:
                probed.setdefault(key, []).append(x)
        known.add(x)
        if any(within(x, y, tau) for y in near):
            out.append(k)
    return out


# --- tables


def _place(key: str) -> Column:
    """Where a line stands: orders by document id (null last), text hash and line."""
    return F.struct(col(key).isNull().alias("z"), col(key).alias("d"), F.col("th"), F.col("no"))


def occurrences(docs: DataFrame, text: str, key: str, min_chars: int) -> DataFrame:
    """(h, len, place, chars of the document): one row per compared line."""
    t = col(text)
    lines = docs.where(t.isNotNull()).select(
        col(key), F.xxhash64(t).alias("th"), F.length(t).alias("chars"), F.posexplode(F.split(t, "\n", -1)).alias("no", "line")
    )
    lines = lines.where((F.length("line") >= min(EXACT_CHARS, min_chars)) & F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return lines.select(class_hash(F.col("line")).alias("h"), F.length("line").alias("len"), _place(key).alias("place"), "chars")


def _bit_map(spark, hashes: DataFrame):
    """A map of fixed size in which the bits of all these hashes are set, for the executors."""
    at = hashes.select(F.pmod("h", F.lit(MAP_BITS)).alias("b"))
    rows = at.groupBy(F.floor(F.col("b") / 32768).cast("int").alias("k")).agg(F.bitmap_construct_agg((F.col("b") % 32768).cast("long")).alias("m")).collect()
    out = np.zeros(MAP_BITS // 8, np.uint8)  # at most MAP_BITS / 32768 rows of 4 KB
    for r in rows:
        part = np.frombuffer(bytes(r["m"]), np.uint8)
        out[r["k"] * 4096 : r["k"] * 4096 + len(part)] = part
    return spark.sparkContext.broadcast(out.tobytes())


def _is_set(bits: bytes, h: int) -> int:
    b = h % MAP_BITS
    return bits[b >> 3] >> (b & 7) & 1


def _keyed(docs: DataFrame, text: str, min_chars: int, tau: int) -> DataFrame:
    """(key, c): index and probe keys of all lines, of equal lines in a batch once; the lowest bit of both marks probes."""

    def work(it):
        for pdf in it:
            lines = {x for t in pdf["t"] if t for x in t.split("\n") if len(x) >= min_chars and not blank(x)}
            key: list[int] = []
            owner, counts = [], []
            for x in lines:
                index, probes = keys(x, tau)
                key += index
                key += probes
                owner.append(line_hash(x))
                counts.append((len(index), len(probes)))
            n = np.array(counts, np.int64).reshape(-1, 2)
            side = np.repeat(np.tile(np.array([0, 1]), len(n)), n.ravel())
            c = np.repeat(np.array(owner, np.int64), n.sum(axis=1)) | side
            yield pd.DataFrame({"key": np.array(key, np.uint64).view(np.int64) & ~1 | side, "c": c})

    return docs.select(col(text).alias("t")).mapInPandas(work, "key long, c long")


def _sorted_keys(docs: DataFrame, text: str, min_chars: int, tau: int) -> DataFrame:
    """The rows of :func:`_keyed` key by key, index first. One number tells the order, so Spark sorts by radix."""
    return _keyed(docs, text, min_chars, tau).repartition(F.shiftright("key", 1)).sortWithinPartitions("key")


def _meeting(it):
    """Rows of the keys that the index of one class and another class share. Rows come by key, index first.

    Of a run that goes on in the next batch only its state is kept: to skip (no index), to keep (two
    classes have met), or the row or two of its only class so far.
    """
    open_key, mode, held = None, "", []
    for pdf in it:
        key, c = pdf["key"].to_numpy(), pdf["c"].to_numpy()
        if not len(key):
            continue
        if mode == "hold" and held:
            key, c = np.concatenate([np.full(len(held), open_key), key]), np.concatenate([np.array(held, np.int64), c])
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        cls = c & ~1
        met = ((c[starts] & 1) == 0) & (np.maximum.reduceat(cls, starts) != np.minimum.reduceat(cls, starts))
        if open_key is not None and key[0] == open_key and mode != "hold":
            met[0] = mode == "keep"
        last = starts[-1]
        if len(starts) == 1 and open_key is not None and key[0] == open_key and mode != "hold":
            pass  # the same run goes on in the same mode
        else:
            open_key = key[last]
            mode = "keep" if met[-1] else "hold" if (c[last] & 1) == 0 else "skip"
            held = sorted(set(c[last:].tolist()), key=lambda x: x & 1) if mode == "hold" else []
        keep = np.repeat(met, np.diff(np.r_[starts, len(key)]))
        yield pd.DataFrame({"key": key[keep], "c": c[keep]})


def _texts(docs: DataFrame, text: str, bits) -> DataFrame:
    """(h, len, line) of the lines whose bit is set."""

    def work(it):
        for pdf in it:
            lines = {x for t in pdf["t"] if t for x in t.split("\n")}
            found = [(h, len(x), x) for x in lines if _is_set(bits.value, h := line_hash(x))]
            yield pd.DataFrame(found, columns=["h", "len", "line"])

    return docs.select(col(text).alias("t")).mapInPandas(work, "h long, len int, line string")


RUN = ["key", "lo", "hi"]
PLACE = ("z", "d", "th", "no")


def _verified(it, tau: int):
    """For each class of a run (key, pair of blocks) its earliest linked class."""

    def run(g: pd.DataFrame):
        lines, counts = g["line"].tolist(), np.stack([character_counts(x) for x in g["line"]])
        place, probe, block = list(zip(*[g[c].tolist() for c in PLACE], strict=True)), g["probe"].to_numpy(), g["block"].to_numpy()
        h, size = g["h"].tolist(), g["len"].to_numpy()
        lo, hi = g["lo"].iloc[0], g["hi"].iloc[0]
        best: dict[int, int] = {}
        index = np.flatnonzero(~probe)
        for i in range(len(h)):
            near = index[np.abs(counts[index] - counts[i]).sum(axis=1) <= 2 * tau]
            if lo != hi:
                near = near[block[near] != block[i]]
            for j in near:
                if h[i] != h[j] and abs(int(size[i]) - int(size[j])) <= tau and within(lines[i], lines[j], tau):
                    late, early = (i, j) if place[i] > place[j] else (j, i)
                    if late not in best or place[early] < place[best[late]]:
                        best[late] = early
        return [(h[i], int(size[i]), h[j], int(size[j])) for i, j in best.items()]

    rest = None
    for pdf in it:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        group = pdf[RUN].to_numpy()
        starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
        rest = pdf.iloc[starts[-1] :]
        out = [x for s, e in zip(starts[:-1], starts[1:], strict=True) if e - s > 1 for x in run(pdf.iloc[s:e])]
        yield pd.DataFrame(out, columns=["h", "len", "h2", "len2"])
    if rest is not None and len(rest) > 1:
        yield pd.DataFrame(run(rest), columns=["h", "len", "h2", "len2"])


def linked_classes(docs: DataFrame, classes: DataFrame, *, text: str, min_chars: int, tau: int) -> DataFrame:
    """(h, len, place): for each class with an earlier linked class the place of the earliest found for it."""
    spark = docs.sparkSession
    dealt = _sorted_keys(docs, text, min_chars, tau)
    met = dealt.mapInPandas(lambda it: _meeting(pdf.assign(key=pdf["key"] & ~1) for pdf in it), "key long, c long").distinct()
    met = materialize(met.select("key", F.col("c").bitwiseAND(F.lit(~1)).alias("h"), (F.col("c").bitwiseAND(F.lit(1)) == 1).alias("probe")), "line-candidates")
    shared = met.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    texts = _texts(docs, text, _bit_map(spark, met.select("h"))).groupBy("h", "len").agg(F.first("line").alias("line"))
    known = classes.where(F.col("len") >= min_chars).select("h", "len", *[F.col(f"place.{c}").alias(c) for c in PLACE]).join(texts, ["h", "len"])
    full = _join(met, shared, "key").join(known, "h").withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")).cast("int"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = full.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "probe", "h", "len", "line", *PLACE)
    dealt = full.repartition(*RUN).sortWithinPartitions(*RUN)
    pairs = dealt.mapInPandas(lambda it: _verified(it, tau), "h long, len int, h2 long, len2 int")
    pairs = materialize(pairs.distinct(), "line-links")
    first = classes.select(F.col("h").alias("h2"), F.col("len").alias("len2"), "place")
    return pairs.join(first, ["h2", "len2"]).groupBy("h", "len").agg(F.min("place").alias("place"))


def _numbers(gone: DataFrame) -> DataFrame:
    return gone.groupBy("d", "th").agg(F.array_distinct(F.flatten(F.collect_list("nos"))).alias("nos"))


def true_copies(docs: DataFrame, held: DataFrame, gone: DataFrame, *, text: str, key: str, similarity: float, words: int) -> DataFrame:
    """(u): the documents of held (d, th, sd, sth) that are as similar to their source, after the drops of gone."""
    ident = lambda d, th: F.xxhash64(d, th)
    pairs = held.select(ident("d", "th").alias("u"), ident("sd", "sth").alias("v"))
    some = pairs.select("u").union(pairs.select("v")).distinct()
    drops = _numbers(gone).select(ident("d", "th").alias("u"), "nos")
    own = docs.where(col(text).isNotNull()).select(ident(col(key), F.xxhash64(col(text))).alias("u"), col(text).alias("t"))
    own = own.join(some, "u").groupBy("u").agg(F.first("t").alias("t")).join(drops, "u", "left")

    def whole(t: pd.Series, nos: pd.Series) -> pd.Series:
        out = []
        for x, n in zip(t, nos, strict=True):
            gone = set() if n is None else set(n.tolist())
            out.append(shingles("\n".join(y for k, y in enumerate(x.split("\n")) if k not in gone), words).view(np.int64))
        return pd.Series(out, dtype=object)

    sets = materialize(own.select("u", F.pandas_udf(whole, "array<long>")("t", "nos").alias("set")), "copy-sets")
    both = _join(_join(pairs, sets.toDF("u", "su"), "u"), sets.toDF("v", "sv"), "v").withColumn("same", F.size(F.array_intersect("su", "sv")))
    return both.where(F.col("same") / (F.size("su") + F.size("sv") - F.col("same")) >= similarity).select("u").distinct()


def duplicates(
    docs: DataFrame, *, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, tau: int = DISTANCE, copy_share: float | None = None,
    similarity: float | None = None, words: int = COPY_WORDS,
) -> DataFrame:
    """(d, th, nos): for each document with duplicate lines their numbers, from 0."""
    rows = materialize(occurrences(docs, text, key, min_chars), "line-places")
    classes = rows.groupBy("h", "len").agg(F.min("place").alias("place"), F.count(F.lit(1)).alias("n"))
    classes = materialize(classes, "line-classes")
    links = linked_classes(docs, classes, text=text, min_chars=min_chars, tau=tau).select("h", "len", F.col("place").alias("earlier"))
    source = classes.join(links, ["h", "len"], "left").where("n > 1 OR earlier IS NOT NULL")
    source = source.select("h", "len", F.least("place", "earlier").alias("source"))
    both = F.xxhash64("h", "len")
    later = rows.withColumn("hl", both).join(source.withColumn("hl", both), ["h", "len", "hl"]).where(F.col("source") < F.col("place"))
    if copy_share is None:
        return later.groupBy(F.col("place.d").alias("d"), F.col("place.th").alias("th")).agg(F.collect_set("place.no").alias("nos"))
    inside = (F.col("place.d").eqNullSafe(F.col("source.d"))) & (F.col("place.th") == F.col("source.th"))
    by_source = later.groupBy(
        F.col("place.d").alias("d"), F.col("place.th").alias("th"), F.col("source.d").alias("sd"), F.col("source.th").alias("sth"), inside.alias("inside")
    ).agg(F.sum("len").alias("held"), F.max("chars").alias("chars"), F.collect_set("place.no").alias("nos"))
    again = F.pandas_udf(lambda s: s.map(lambda t: repeats(t, min_chars, tau)), "array<int>").asNondeterministic()  # evaluated once, not again by the filter
    own = docs.where(col(text).isNotNull()).select(col(key).alias("d"), F.xxhash64(col(text)).alias("th"), again(col(text)).alias("nos")).where(F.size("nos") > 0)
    copied = ~F.col("inside") & (F.col("held") > F.col("chars") * copy_share)
    if similarity is None:
        return _numbers(by_source.where(~copied).select("d", "th", "nos").unionByName(own))
    by_source, own = materialize(by_source, "line-sources"), materialize(own, "line-repeats")
    held, gone = by_source.where(copied), by_source.where(~copied).select("d", "th", "nos").unionByName(own)
    true = true_copies(docs, held, gone, text=text, key=key, similarity=similarity, words=words)
    more = held.withColumn("u", F.xxhash64("d", "th")).join(true, "u", "left_anti").select("d", "th", "nos")
    return _numbers(gone.unionByName(more))


def dedup(docs: DataFrame, *, text: str = "text", key: str = "doc_id", dropped: str | None = None, **options) -> DataFrame:
    """The documents without their duplicate lines; ``dropped`` names a column with the number of lines taken."""
    spark = docs.sparkSession
    gone = materialize(duplicates(docs, text=text, key=key, **options), "line-drops")
    bits = _bit_map(spark, gone.select(F.col("th").alias("h")))
    th, nos, same_id, same_hash = fresh(docs, "text_hash", "line_nos", "drop_id", "drop_hash")
    touched = F.pandas_udf(lambda s: s.map(lambda h: bool(_is_set(bits.value, h))).astype(bool), "boolean")
    hashed = docs.withColumn(th, F.xxhash64(col(text)))
    some, rest = hashed.where(touched(col(th))), hashed.where(~touched(col(th)))
    drops = gone.select(F.col("d").alias(same_id), F.col("th").alias(same_hash), F.col("nos").alias(nos))
    joined = some.join(drops, col(key).eqNullSafe(col(same_id)) & (col(th) == col(same_hash)), "left")
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), col(nos))
    body = let(F.split(col(text), "\n", -1), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))
    clean = F.when(col(nos).isNull(), col(text)).otherwise(body)
    out = [clean.alias(c) if c == text else col(c) for c in docs.columns]
    more = [F.coalesce(F.size(nos), F.lit(0)).cast("long").alias(dropped)] if dropped else []
    none = [F.lit(0).cast("long").alias(dropped)] if dropped else []
    return joined.select(*out, *more).unionByName(rest.select(*[col(c) for c in docs.columns], *none))


def op7_line_dedup(spark, sf_dir: str) -> DataFrame:
    clean = dedup(documents(spark, sf_dir).select("doc_id", "text"), dropped="n_dropped")
    lines = F.size(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    return clean.select("doc_id", F.coalesce(lines, F.lit(0)).cast("long").alias("n_lines"), "n_dropped", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))
