"""SimHash near-duplicates with Golay-code fuzzy keys.

Fingerprints have 64 bits from 3-word shingles. They are cut into segments of 22, 21 and 21 bits.
With 2 differing bits at most, one segment is equal in both (pigeonhole), and the next one differs in
2 bits at most. The perfect binary Golay code has words of 23 bits, each within 3 bits of exactly one
codeword; the codewords within 4 bits of a segment (one, or six where it is 3 bits off its own) are
its indices, and segments 2 bits apart share one. A key is an equal segment with one index of the
next: about 16 keys a fingerprint, 35 bits each. Fingerprints that share a key are compared exactly.

Equal fingerprints count once. A key with many fingerprints is cut into blocks, and each pair of
blocks is a piece of work of its own that returns a spanning forest of the links it finds instead of
all of them; so nothing is capped, and no task gets a whole key.

:func:`keep_one` can also go by exact similarity: the Jaccard coefficient of the sets of word shingles of
two whole texts (:func:`similar_links`). At a coefficient of 0.8 about 10 of 64 bits differ, with a
spread that reaches 18: too many for equal segments. The SimHash is therefore wider there, ``2 * TABLES``
segments of 24 bits, and each segment's index is a codeword of the extended Golay code found by soft
decision: the sums behind the bits are correlated with the 4,096 codewords, so bits that nearly came out
the other way weigh little. A key is a pair of indices of two segments, the ``PROBES`` likeliest of each
pair: 112 keys a text. Texts that share a key are compared on the first 128 bits (``WIDE_BITS`` may
differ); what is connected by that is a group, whose whole sets are compared, all with all in blocks, or,
in groups of more than ``WHOLE`` blocks, those that share a key. A pair at 0.8 shares a key of one pair of segments with a probability
of 0.58 and of none of the 14 with one of 5e-6 (both for normal sums), closer ones with less.

Defined results: texts without words have fingerprint zero and link like any other; a null id never
is a component's id unless all its documents have none; repeated rows are documents of one component;
an empty table gives an empty table; texts are read whole however long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.llm.common import col, documents, fresh, materialize
from reportmill.llm.components import _join, components

SHINGLE = 3
SEED = 42
MAX_BITS = 2
#: Fingerprints in a block.
BLOCK = 1024
#: Shingles in a block of sets, and columns of an incidence matrix.
ELEMENTS, COLUMNS = 1 << 19, 2048
#: Blocks of sets in a group of close fingerprints that is compared all with all: each set is dealt so often.
WHOLE = 16
#: Pairs of segments of a wide fingerprint, codewords tried of a segment, keys taken of a pair, for exact similarity.
TABLES, CODEWORDS, PROBES = 14, 4, 8
#: Bits of the first 128 in which similar texts may differ (19 in the mean at 0.8, 24 for sets of five shingles).
WIDE_BITS = 44

# --- fingerprints


def fingerprint(text: str | None) -> int:
    """SimHash of a whole text as a signed 64-bit number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE:
        h = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        digest = xxhash.xxh64_intdigest
        h = np.array([digest(b"%b %b %b" % w, SEED) for w in zip(words, words[1:], words[2:])], np.uint64)  # noqa: B905
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        bits = np.unpackbits(h[i : i + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    value = int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")
    return value - (1 << 64) if value >> 63 else value


def with_fingerprint(docs: DataFrame, *, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """Adds the fingerprint of each whole text (long)."""
    (out,) = fresh(docs, name)
    work = F.pandas_udf(lambda s: s.map(fingerprint).astype("int64"), "long")
    return docs.withColumn(out, work(col(text)))


# --- Golay keys

SEGMENTS = ((0, 22), (22, 21), (43, 21))
_POLY = 0b101011100011  # generator of the binary Golay code


def _syndrome(v: np.ndarray) -> np.ndarray:
    v = v.copy()
    for i in range(22, 10, -1):
        v = np.where((v >> i) & 1, v ^ (_POLY << (i - 11)), v)
    return v


def _leaders() -> np.ndarray:
    """The error pattern of at most 3 bits of each of the 2,048 syndromes."""
    one = [1 << i for i in range(23)]
    errors = [0, *one, *(a | b for i, a in enumerate(one) for b in one[:i])]
    errors += [a | b | c for i, a in enumerate(one) for j, b in enumerate(one[:i]) for c in one[:j]]
    errors = np.array(errors, np.int64)
    out = np.zeros(2048, np.int64)
    out[_syndrome(errors)] = errors
    return out


_LEADER = _leaders()


def codeword_index(v: np.ndarray) -> np.ndarray:
    """The index (12 message bits) of the codeword nearest to each 23-bit word."""
    return (v ^ _LEADER[_syndrome(v)]) >> 11


def segment_indices(v: np.ndarray) -> np.ndarray:
    """Indices of the codewords within 4 bits of each word: one row a word, repeats at their first place only, else -1."""
    near = np.stack([codeword_index(v)] + [codeword_index(v ^ (1 << i)) for i in range(23)], axis=1)
    near.sort(axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return near


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) pairs."""
    u = fps.astype(np.int64).view(np.uint64)
    part = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    who, key = [], []
    for i in range(3):
        near = segment_indices(part[(i + 1) % 3])
        rows, cols = np.nonzero(near >= 0)
        who.append(rows)
        key.append((i << 34) | (part[i][rows] << 12) | near[rows, cols])
    return np.concatenate(who), np.concatenate(key)


# --- links


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among a few fingerprints."""
    n = len(fps)
    if n == 2:
        return [(int(fps[0]), int(fps[1]))] if ((int(fps[0]) ^ int(fps[1])) & ((1 << 64) - 1)).bit_count() <= MAX_BITS else []
    u, left, out = fps.view(np.uint64), np.ones(n, bool), []
    for i in range(n):
        if not left[i]:
            continue
        left[i], todo = False, [i]
        while todo:
            j = todo.pop()
            rest = np.flatnonzero(left)
            found = rest[np.bitwise_count(u[rest] ^ u[j]) <= MAX_BITS]
            left[found] = False
            out += [(int(fps[j]), int(fps[k])) for k in found]
            todo += found.tolist()
    return out


def _links(it):
    """Runs of equal (key, lo, hi), which may go on in the next batch."""
    rest = None
    for pdf in it:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        group = pdf[["key", "lo", "hi"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
        rest = pdf.iloc[starts[-1] :]
        fps, ends = pdf["fp"].to_numpy(), starts[1:]
        yield _edges(fps[s:e] for s, e in zip(starts[:-1], ends, strict=True))
    if rest is not None:
        yield _edges([rest["fp"].to_numpy()])


def _edges(groups) -> pd.DataFrame:
    found = {p for g in groups if len(g) > 1 for p in forest(g)}
    return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")


def links(nodes: DataFrame, fp: str = "fp") -> DataFrame:
    """Edges (a, b) that connect all distinct fingerprints within MAX_BITS of each other."""

    def explode(it):
        for pdf in it:
            fps = pdf["fp"].to_numpy()
            who, key = keys(fps)
            yield pd.DataFrame({"key": key, "fp": fps[who]})

    keyed = nodes.select(col(fp).alias("fp")).mapInPandas(explode, "key long, fp long")
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = _join(keyed, shared, "key").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = blocks.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "fp")
    dealt = pairs.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInPandas(_links, "a long, b long")


# --- exact similarity


def shingles(text: str | None, width: int) -> np.ndarray:
    """The set of hashes of a text's word shingles, sorted; a text of fewer words is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    last = max(len(words) - width, 0) if words else -1
    return np.unique(np.array([digest(b" ".join(words[i : i + width]), SEED) for i in range(last + 1)], np.uint64))


_WORDS = -(-2 * TABLES * 24 // 64)
_ADD = np.array([0] + [xxhash.xxh64_intdigest(b"add", i) for i in range(1, _WORDS)], np.uint64)


def _codebook() -> np.ndarray:
    """The 4,096 codewords of the extended Golay code as columns of +1 and -1, by their 12 message bits."""
    message = np.arange(4096, dtype=np.int64) << 11
    bits = ((message ^ _syndrome(message))[:, None] >> np.arange(23)) & 1
    return (2 * np.c_[bits, bits.sum(axis=1) & 1] - 1).T.astype(np.float32)


_CODE = _codebook()


def wide_sums(found: np.ndarray) -> np.ndarray:
    """Per bit of the wide SimHash of a set: hashes with a one less hashes with a zero. The first 64 bits are of the hashes themselves."""
    ones = np.zeros(64 * _WORDS, np.int64)
    for i in range(0, len(found), 8192):
        h = found[i : i + 8192, None] + _ADD
        for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(33)
        h[:, 0] = found[i : i + 8192]
        ones += np.unpackbits(h.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return 2 * ones - len(found)


def soft_keys(sums: np.ndarray) -> np.ndarray:
    """Keys of wide fingerprints (a row of sums each): for each pair of segments the likeliest pairs of codewords."""
    scores = sums[:, : 2 * TABLES * 24].astype(np.float32).reshape(-1, 24) @ _CODE
    row = np.arange(len(scores))
    index, value = np.empty((len(row), CODEWORDS), np.int32), np.empty((len(row), CODEWORDS), np.float32)
    for i in range(CODEWORDS):
        best = scores.argmax(axis=1)
        index[:, i], value[:, i] = best, scores[row, best]
        scores[row, best] = -np.inf
    index, value = index.reshape(-1, TABLES, 2, CODEWORDS), value.reshape(-1, TABLES, 2, CODEWORDS)
    both = (value[:, :, 0, :, None] + value[:, :, 1, None, :]).reshape(-1, TABLES, CODEWORDS**2)
    pair = ((index[:, :, 0, :, None] << 12) | index[:, :, 1, None, :]).reshape(both.shape)
    likeliest = np.argsort(-both, axis=2, kind="stable")[:, :, :PROBES]
    found = np.take_along_axis(pair, likeliest, axis=2) | (np.arange(TABLES, dtype=np.int32) << 24)[:, None]
    return found.reshape(len(sums), TABLES * PROBES)


def with_wide_fingerprint(docs: DataFrame, text: str, width: int, name: str) -> DataFrame:
    """Adds a struct: fp (hash of the set of shingles), f0 and f1 (first 128 bits of the wide SimHash), its keys (none of an empty set)."""

    def work(s: pd.Series) -> pd.DataFrame:
        fps, bits, keys = [], [], []
        for i in range(0, len(s), 16):
            sets = [shingles(t, width) for t in s.iloc[i : i + 16]]
            sums = np.stack([wide_sums(x) for x in sets])
            fps += [xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets]
            bits.append(np.packbits(sums[:, :128] > 0, axis=1, bitorder="little").view("<i8"))
            keys += [k if len(x) else k[:0] for k, x in zip(soft_keys(sums), sets, strict=True)]
        both = np.concatenate([np.empty((0, 2), np.int64), *bits])
        return pd.DataFrame({"fp": np.array(fps, np.uint64).view(np.int64), "f0": both[:, 0], "f1": both[:, 1], "keys": pd.Series(keys, dtype=object)})

    return docs.withColumn(name, F.pandas_udf(work, "fp long, f0 long, f1 long, keys array<int>")(col(text)))


def _near(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits[i] ^ bits[j]).sum(axis=-1, dtype=np.int16)


def _stars(fps: np.ndarray, bits: np.ndarray) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Of a run: pairs of a central fingerprint with those within WIDE_BITS of it, and which ones have further pairs."""
    n = len(fps)
    spare = np.empty((n, n), np.int16)  # bits to spare, 0 where too far
    for i in range(n):
        spare[i] = np.maximum(WIDE_BITS + 1 - _near(bits, np.array([i]), np.arange(n)), 0)
    spare[np.arange(n), np.arange(n)] = 0
    weight, out = spare.sum(axis=1, dtype=np.int64), []
    close, left, rest = spare > 0, weight > 0, spare > 0
    while left.any():
        head = int(np.argmax(np.where(left, weight, -1)))
        found = np.flatnonzero(close[head])
        out += [(int(fps[head]), int(fps[k])) for k in found]
        left[head] = left[found] = False
        rest[head] = rest[:, head] = False
    return out, rest.any(axis=1)


def _whole_runs(it):
    """Tables of whole runs (rows of equal ``run``), which may go on in the next batch."""
    rest = None
    for pdf in it:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        run = pdf["run"].to_numpy()
        last = int(np.searchsorted(run, run[-1]))
        rest = pdf.iloc[last:]
        if last:
            yield pdf.iloc[:last]
    if rest is not None:
        yield rest


def _least_close(fps: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Of a run: for each row the least number of those it is connected with by steps of at most WIDE_BITS."""
    out, left = fps.copy(), np.ones(len(fps), bool)
    for i in np.argsort(fps):
        if not left[i]:
            continue
        left[i], todo = False, [i]
        while todo:
            j = todo.pop()
            rest = np.flatnonzero(left)
            found = rest[_near(bits, rest, np.array([j])) <= WIDE_BITS]
            left[found], out[found] = False, fps[i]
            todo += found.tolist()
    return out


def _connected_runs(it):
    """Edges (a, b) that connect the numbers (a fingerprint or its group) of close rows of each run: at most one a row."""
    for pdf in _whole_runs(it):
        run, fps, bits = pdf["run"].to_numpy(), pdf["fp"].to_numpy(), pdf[["f0", "f1"]].to_numpy("int64").view(np.uint64)
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        size = np.diff(np.r_[starts, len(run)])
        mixed = np.maximum.reduceat(fps, starts) != np.minimum.reduceat(fps, starts)
        least, at = fps.copy(), np.flatnonzero(np.repeat(mixed & (size <= 64), size))
        step, one, two = 1, [at[:0]], [at[:0]]
        while len(at):  # short runs, all at once: each row with the one so many steps on
            at = at[at + step < len(run)]
            at = at[run[at] == run[at + step]]
            hit = at[_near(bits, at, at + step) <= WIDE_BITS]
            one.append(hit)
            two.append(hit + step)
            step += 1
        i, j = np.concatenate(one), np.concatenate(two)
        while (least[i] != least[j]).any():
            low = np.minimum(least[i], least[j])
            np.minimum.at(least, i, low)
            np.minimum.at(least, j, low)
        for k in np.flatnonzero(mixed & (size > 64)):
            part = slice(starts[k], starts[k] + size[k])
            least[part] = _least_close(fps[part], bits[part])
        yield pd.DataFrame({"a": least, "b": fps})[least != fps].drop_duplicates()


def _close_runs(it):
    """Of runs of fingerprints that share a key, which may go on in the next batch: pairs to compare (a, b, -1) and, where
    a run has more close pairs than those, its members (a, a, key)."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        run, fps, bits = pdf["run"].to_numpy(), pdf["fp"].to_numpy(), pdf[["f0", "f1"]].to_numpy("int64").view(np.uint64)
        starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        size = np.diff(np.r_[starts, len(run)])
        length = np.repeat(size, size)
        close = np.zeros(len(starts), bool)
        of = np.repeat(np.arange(len(starts)), size)
        at = np.flatnonzero((length > 1) & (length <= 64))
        step = 1
        while len(at):  # short runs, all at once: each row with the one so many steps on
            at = at[at + step < len(run)]
            at = at[of[at] == of[at + step]]
            hit = at[_near(bits, at, at + step) <= WIDE_BITS]
            close[of[hit]] = True
            step += 1
        pairs, members = [], []
        for k in np.flatnonzero(close | (size > 64)):
            part = slice(starts[k], starts[k] + size[k])
            if size[k] == 2:
                pairs.append((int(fps[starts[k]]), int(fps[starts[k] + 1])))
                continue
            found, rest = _stars(fps[part], bits[part])
            pairs += found
            members += [(int(f), int(run[starts[k]] >> 32)) for f in fps[part][rest]]
        pairs = {(min(p), max(p)) for p in pairs}
        return pd.DataFrame([(*p, -1) for p in sorted(pairs)] + [(f, f, key) for f, key in members], columns=["a", "b", "key"], dtype="int64")

    return map(work, _whole_runs(it))


def _hot_keys(nodes: DataFrame) -> DataFrame:
    """(key, blocks) of keys with many fingerprints."""
    hot = nodes.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * BLOCK)
    return materialize(hot, "hot-keys").select("key", F.least(F.ceil(F.col("n") / BLOCK), F.lit(65535)).cast("int").alias("blocks"))


def _dealt_runs(nodes: DataFrame, hot: DataFrame, name: str = "fp") -> DataFrame:
    """(run, name as fp, f0, f1) of nodes (fp, f0, f1, keys), run by run: a key, or a pair of blocks of a hot one."""
    keyed = nodes.select("f0", "f1", F.col(name).alias("fp"), F.xxhash64("fp").alias("hash"), F.explode("keys").alias("key"))
    cut = keyed.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod("hash", F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = lambda c, n: F.shiftleft(c.cast("long"), n)
    run = place(F.col("key"), 32).bitwiseOR(place(F.least("block", "other"), 16)).bitwiseOR(F.greatest("block", "other").cast("long"))
    return cut.select(run.alias("run"), "fp", "f0", "f1").repartition("run").sortWithinPartitions("run")


def close_fingerprints(nodes: DataFrame) -> DataFrame:
    """Rows (a, b, key) of :func:`_close_runs` for nodes (fp, f0, f1, keys)."""
    return _dealt_runs(nodes, _hot_keys(nodes)).mapInPandas(_close_runs, "a long, b long, key long")


def close_groups(nodes: DataFrame) -> DataFrame:
    """(fp, key): the fingerprints of nodes (fp, f0, f1, keys) that are close to one of the same key; key tells what they connect.

    The likeliest key of each pair of segments comes first; all keys then have to tell only what connects different groups of that.
    """
    hot = _hot_keys(nodes)
    connected = lambda n, name: components(_dealt_runs(n, hot, name).mapInPandas(_connected_runs, "a long, b long"))
    likeliest = nodes.withColumn("keys", F.filter("keys", lambda _, i: i % PROBES == 0))
    known = connected(likeliest, "fp").toDF("fp", "known")
    grouped = materialize(nodes.join(known, "fp", "left").withColumn("root", F.coalesce("known", "fp")), "likely-groups")
    more = connected(grouped, "root").toDF("root", "more")
    found = grouped.select("fp", "known", "root").join(more, "root", "left")
    return found.select("fp", F.coalesce("more", "known").alias("key")).where("key IS NOT NULL")


def similar_sets(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which pairs of a few sets (sorted hashes) are at least so similar, as a boolean matrix, from products of incidence matrices."""
    n, size = len(sets), np.array([len(x) for x in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = count > 1  # what only one set holds is in no intersection
    at = np.flatnonzero(often[column])
    at = at[np.argsort(column[at], kind="stable")]
    owner, place = np.repeat(np.arange(n), size)[at], (np.cumsum(often) - 1)[column[at]]
    same = np.zeros((n, n), np.float32)
    for first in range(0, int(often.sum()), COLUMNS):
        lo, hi = np.searchsorted(place, [first, first + COLUMNS])
        m = np.zeros((n, COLUMNS), np.float32)
        m[owner[lo:hi], place[lo:hi] - first] = 1
        same += m @ m.T
    out = np.zeros((n, n), bool)
    for i in range(0, n, 256):
        part = same[i : i + 256].astype(np.float64)
        out[i : i + 256] = part / (size[i : i + 256, None] + size[None, :] - part) >= similarity
    return out


def _similar_runs(it, similarity: float):
    """Spanning forests of the links in runs of equal (key, lo, hi), which may go on in the next batch."""

    def run(g: pd.DataFrame) -> list[tuple[int, int]]:
        if len(g) < 2:
            return []
        near, fps, block = similar_sets(g["set"].tolist(), similarity), g["fp"].to_numpy(), g["block"].to_numpy()
        if g["lo"].iloc[0] != g["hi"].iloc[0]:
            near &= block[:, None] != block[None, :]  # pairs inside a block are another piece of work
        left, out = np.ones(len(fps), bool), []
        for i in range(len(fps)):
            if not left[i]:
                continue
            left[i], todo = False, [i]
            while todo:
                j = todo.pop()
                found = np.flatnonzero(near[j] & left)
                left[found] = False
                out += [(int(fps[j]), int(fps[k])) for k in found]
                todo += found.tolist()
        return out

    rest = None
    for pdf in it:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if not len(pdf):
            continue
        group = pdf[["key", "lo", "hi"]].to_numpy()
        starts = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]).any(axis=1)])
        rest = pdf.iloc[starts[-1] :]
        for s, e in zip(starts[:-1], starts[1:], strict=True):
            yield pd.DataFrame(run(pdf.iloc[s:e]), columns=["a", "b"], dtype="int64")
    if rest is not None:
        yield pd.DataFrame(run(rest), columns=["a", "b"], dtype="int64")


def _compared(member: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) that connect the similar sets of each key of member (key, fp, blocks), compared in pairs of blocks."""
    cut = member.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "fp")
    dealt = _join(cut, sets, "fp").repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return dealt.mapInPandas(lambda it: _similar_runs(it, similarity), "a long, b long")


def _blocks() -> Column:
    return F.greatest(F.ceil(F.sum("m") / ELEMENTS), F.ceil(F.count(F.lit(1)) / BLOCK)).cast("int").alias("blocks")


def similar_links(rows: DataFrame, width: int, similarity: float) -> DataFrame:
    """Edges (a, b) that connect all sets of shingles at least so similar, of rows (fp, f0, f1, keys, text).

    Fingerprints that share a key and are close are candidates. What they connect is a group, whose sets are
    compared all with all in pairs of blocks of bounded size, which give a spanning forest each: no pairs are
    listed, and a set is dealt at most ``WHOLE`` times. Larger groups go by their keys (:func:`_links_by_key`).
    """
    nodes = materialize(rows.groupBy("fp").agg(*[F.first(c).alias(c) for c in ("f0", "f1", "keys")]), "wide-fingerprints")
    near = materialize(close_groups(nodes), "close-groups")
    texts = rows.select("fp", "text").join(near.select("fp"), "fp").groupBy("fp").agg(F.first("text").alias("text"))
    whole = F.pandas_udf(lambda s: s.map(lambda t: shingles(t, width).view(np.int64)), "array<long>")
    sets = materialize(texts.select("fp", whole("text").alias("set")), "shingle-sets")
    blocks = _join(near, sets.select("fp", F.size("set").alias("m")), "fp").groupBy("key").agg(_blocks())
    member = materialize(_join(near, blocks, "key"), "close-blocks")
    edges = _compared(member.where(F.col("blocks") <= WHOLE), sets, similarity)
    large = member.where(F.col("blocks") > WHOLE).select("fp")
    return edges if large.isEmpty() else edges.unionByName(_links_by_key(nodes.join(large, "fp"), sets, similarity))


def _links_by_key(nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The same edges for groups of any size, of nodes (fp, f0, f1, keys) and their sets.

    First each is compared, on the whole sets, with the one of its key that is closest to the others (as the
    original of many copies is). Where a key then still holds close ones of different components, all its sets
    that are close to another are compared in pairs of blocks. A large group of near copies of one text costs no
    square of its sets unless many of them are farther from it.
    """
    close = materialize(close_fingerprints(nodes), "close-fingerprints")
    stars = close.where("key < 0").select("a", "b").distinct()
    keyed = close.where("key >= 0").select("key", F.col("a").alias("fp")).distinct()
    sized = sets.select("fp", F.size("set").alias("m"))
    fit = _join(_join(stars, sized.toDF("a", "na"), "a"), sized.toDF("b", "nb"), "b")
    fit = fit.where(F.least("na", "nb") >= F.greatest("na", "nb") * similarity)
    both = _join(_join(fit, sets.toDF("a", "sa"), "a"), sets.toDF("b", "sb"), "b").withColumn("same", F.size(F.array_intersect("sa", "sb")))
    first = materialize(both.where(F.col("same") / (F.col("na") + F.col("nb") - F.col("same")) >= similarity).select("a", "b"), "similar")
    roots = components(first).select(F.col("node").alias("fp"), "root")
    member = keyed.join(roots, "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    mixed = _join(member, sized, "fp").groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), _blocks()).where("least <> most")
    member = materialize(_join(member.select("key", "fp"), mixed.select("key", "blocks"), "key"), "mixed-keys")
    return first.unionByName(_compared(member, sets, similarity))


def component_of(rows: DataFrame, fp: str, order: str, edges: DataFrame | None = None) -> DataFrame:
    """(fp, first) for each distinct fingerprint: the least ``order`` value of its component."""
    nodes = materialize(rows.groupBy(col(fp).alias("fp")).agg(F.min(order).alias("first")), "fingerprints")
    roots = components(links(nodes) if edges is None else edges).select(F.col("node").alias("fp"), "root")
    least = _join(nodes, roots, "fp").groupBy("root").agg(F.min("first").alias("least"))
    linked = roots.join(least, "root").select("fp", "least")
    return nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "first").alias("first"))


def near_duplicates(docs: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, fingerprint, component): one row per document."""
    fp = fresh(docs, "fp_value")[0]
    rows = materialize(with_fingerprint(docs.select(key, text), text=text, name=fp).select(col(key).alias("k"), col(fp).alias("fp")), "simhash")
    return _join(rows, component_of(rows, "fp", "k"), "fp").select(
        F.col("k").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first").alias("component_id")
    )


def keep_one(docs: DataFrame, *, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One document of each group: that with the least key (null last, then any one of equal keys).

    Groups are of fingerprints within MAX_BITS, or with ``similarity`` of texts whose sets of ``shingle`` words
    have at least that Jaccard coefficient.
    """
    if similarity is None and shingle != SHINGLE:
        raise ValueError("fingerprints are of 3-word shingles; another width needs a similarity")
    fp, row, rank, out = fresh(docs, "fp_value", "row_no", "rank", "gone")
    marked = with_fingerprint(docs, text=text, name=fp) if similarity is None else with_wide_fingerprint(docs, text, shingle, fp)
    rows = materialize(marked.withColumn(row, F.monotonically_increasing_id()), "simhash-docs")
    order = F.struct(col(key).isNull().alias("n"), col(key).alias("k"), col(row).alias("r"))
    if similarity is None:
        edges, value = None, col(fp)
    else:
        value = col(fp)["fp"]
        edges = similar_links(rows.select(*[col(fp)[c].alias(c) for c in ("fp", "f0", "f1", "keys")], col(text).alias("text")), shingle, similarity)
    small = rows.select(value.alias("fp"), order.alias(rank))
    best = component_of(small, "fp", rank, edges)
    gone = _join(small, best, "fp").where(F.col("first") != col(rank)).select(col(rank)["r"].alias(out))
    return rows.join(gone, col(row) == col(out), "left_anti").select(*[col(c) for c in docs.columns])


def op6_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
