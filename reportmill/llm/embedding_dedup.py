"""Near-duplicate vectors by an epsilon grid order join.

Valid vectors are scaled to length one, where cosine >= t means a distance of at most
``epsilon = sqrt(2 - 2 t)``. Coordinates are rotated to the principal axes of all vectors. Vectors of
one label and dimension are put in the order of their grid cells (width epsilon) on the leading axes;
the sequence is cut into intervals (one a range partition) and these into blocks, each with a bounding
box in all rotated coordinates. Pairs of intervals, then pairs of blocks, whose boxes are farther apart
than epsilon are skipped; the others are joined recursively, halving the blocks and testing boxes
again, down to small leaves that are compared exactly in double precision.

A pair of blocks is one piece of work of bounded size, so a label or a cell that holds a third of all
rows is spread over many tasks. It returns link counts for each vector and a spanning forest of the
links, not the links themselves; components follow from the forests.

Defined results: a vector that is null, empty, zero or holds null or non-finite components, and one
whose label is null, has no links and is its own component; vectors of different lengths do not link;
repeated rows link with each other; an empty table gives an empty table; a null id is never a component's id unless all its members' are.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.llm.common import col, fresh, materialize
from reportmill.llm.components import _join, components

THRESHOLD = 0.93
#: Axes whose cells order the vectors.
AXES = 4
BLOCK = 1024
LEAF = 128
SLACK = 1e-9


def unit_vectors(values: pd.Series) -> list[bytes | None]:
    """Packed doubles of length one, or None for vectors that link with nothing."""
    out: list[bytes | None] = []
    for v in values:
        a = None if v is None or len(v) == 0 else np.array([np.nan if x is None else x for x in v] if not isinstance(v, np.ndarray) or v.dtype == object else v, np.float64)
        top = np.abs(a).max() if a is not None and np.isfinite(a).all() else 0.0
        if not top:
            out.append(None)
            continue
        a = a / top  # so that squares neither overflow nor vanish
        out.append((a / np.sqrt((a * a).sum())).tobytes())
    return out


def _matrix(packed, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(packed), np.float64).reshape(-1, dim)


def principal_axes(rows: DataFrame) -> dict[int, np.ndarray]:
    """The axes (columns, strongest first) of each dimension, from sums over all vectors."""

    def partial(it):
        sums: dict[int, np.ndarray] = {}
        for pdf in it:
            for dim, part in pdf.groupby("dim"):
                m = _matrix(part["unit"], dim)
                sums[dim] = sums.get(dim, 0) + m.T @ m
        for dim, s in sums.items():
            i, j = np.triu_indices(dim)
            yield pd.DataFrame({"dim": dim, "i": i, "j": j, "s": s[i, j]})

    cells = rows.select("dim", "unit").mapInPandas(partial, "dim int, i int, j int, s double")
    found: dict[int, np.ndarray] = {}
    # a number of rows that depends on the dimensions only
    for dim, i, j, s in cells.groupBy("dim", "i", "j").agg(F.sum("s")).collect():
        m = found.setdefault(dim, np.zeros((dim, dim)))
        m[i, j] = m[j, i] = s
    return {dim: np.ascontiguousarray(np.linalg.eigh(m)[1][:, ::-1]) for dim, m in found.items()}


def _boxes_apart(lo1, hi1, lo2, hi2, limit: float) -> bool:
    gap = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
    return float(gap @ gap) > limit


def join_blocks(a: np.ndarray, b: np.ndarray, rotated_a: np.ndarray, rotated_b: np.ndarray, threshold: float, same: bool) -> np.ndarray:
    """Which vectors of two blocks are linked (boolean matrix), by recursive halving."""
    links, limit = np.zeros((len(a), len(b)), bool), 2 - 2 * threshold + SLACK

    def visit(i, j, k, m):
        if same and m <= i:  # the other half of a symmetric matrix
            return
        if _boxes_apart(rotated_a[i:j].min(axis=0), rotated_a[i:j].max(axis=0), rotated_b[k:m].min(axis=0), rotated_b[k:m].max(axis=0), limit):
            return
        if j - i <= LEAF and m - k <= LEAF:
            links[i:j, k:m] = a[i:j] @ b[k:m].T >= threshold
            return
        halves = lambda x, y: [(x, y)] if y - x <= LEAF else [(x, (x + y) // 2), ((x + y) // 2, y)]
        for p in halves(i, j):
            for q in halves(k, m):
                visit(*p, *q)

    visit(0, len(a), 0, len(b))
    if same:
        links |= links.T
        np.fill_diagonal(links, False)
    return links


def spanning_forest(links: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool) -> list[tuple[int, int]]:
    """Links enough to connect what the matrix connects."""
    out, ids = [], left if same else np.concatenate([left, right])
    n = len(left)
    open_ = links.any(axis=1) if same else np.concatenate([links.any(axis=1), links.any(axis=0)])
    for i in range(len(ids)):
        if not open_[i]:
            continue
        open_[i], todo = False, [i]
        while todo:
            j = todo.pop()
            row = links[j] if same or j < n else links[:, j - n]
            at = 0 if same or j >= n else n
            found = np.flatnonzero(row & open_[at : at + len(row)]) + at
            open_[found] = False
            out += [(int(ids[j]), int(ids[k])) for k in found]
            todo += found.tolist()
    return out


def _block_table(rows: DataFrame, axes: dict[int, np.ndarray], epsilon: float, parts: int) -> DataFrame:
    """One row per block of the sequence: interval, ids, packed vectors and the bounding box."""
    cells = [f"c{i}" for i in range(AXES)]

    def place(it):
        for pdf in it:
            place = np.zeros((len(pdf), AXES), int)
            for dim, at in pdf.groupby("dim").indices.items():
                lead = _matrix(pdf["unit"].iloc[at], dim) @ axes[dim][:, :AXES]
                place[at, : lead.shape[1]] = np.floor(lead / epsilon)
            yield pdf.assign(**{c: place[:, i] for i, c in enumerate(cells)})

    placed = rows.mapInPandas(place, rows.schema.simpleString()[7:-1] + "".join(f", {c} int" for c in cells))
    order = ["grp", "dim", *cells, "rid"]
    dealt = placed.repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def cut(it):
        part, no = TaskContext.get().partitionId(), 0

        def block(g):
            nonlocal no
            dim = int(g["dim"].iloc[0])
            m = _matrix(g["unit"], dim) @ axes[dim]
            no += 1
            return [(part << 32) | no, part, g["grp"].iloc[0], dim, g["rid"].tolist(), b"".join(g["unit"]), m.min(axis=0).tolist(), m.max(axis=0).tolist()]

        rest, names = None, ["block", "part", "grp", "dim", "ids", "vectors", "lo", "hi"]
        for pdf in it:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            out, rest = [], None
            for (_, _), g in pdf.groupby(["grp", "dim"], sort=False):
                whole = len(g) // BLOCK * BLOCK
                out += [block(g.iloc[i : i + BLOCK]) for i in range(0, whole, BLOCK)]
                if g.index[-1] == pdf.index[-1]:
                    rest = g.iloc[whole:]  # may go on in the next batch
                elif whole < len(g):
                    out.append(block(g.iloc[whole:]))
            rest = rest if rest is not None and len(rest) else None
            yield pd.DataFrame(out, columns=names)
        if rest is not None:
            yield pd.DataFrame([block(rest)], columns=names)

    kind = "block long, part int, grp string, dim int, ids array<long>, vectors binary, lo array<double>, hi array<double>"
    return dealt.mapInPandas(cut, kind)


def _near(limit: float, a: str, b: str):
    gap = lambda x, y: F.greatest(F.lit(0.0), x, y)
    one = F.zip_with(F.col(f"{a}.lo"), F.col(f"{b}.hi"), lambda x, y: x - y)
    two = F.zip_with(F.col(f"{b}.lo"), F.col(f"{a}.hi"), lambda x, y: x - y)
    return F.aggregate(F.zip_with(one, two, gap), F.lit(0.0), lambda s, g: s + g * g) <= limit


def _pairs(blocks: DataFrame, epsilon: float, threshold: float) -> DataFrame:
    """(a, b) of blocks that may hold links, a <= b: intervals first, then the blocks in them."""
    limit = 2 - 2 * threshold + SLACK
    boxes = blocks.select("block", "part", "grp", "dim", "lo", "hi")
    dims = boxes.select("part", "grp", "dim", F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "x"))
    sides = dims.groupBy("part", "grp", "dim", "i").agg(F.min("x.lo").alias("l"), F.max("x.hi").alias("h"))
    whole = sides.groupBy("part", "grp", "dim").agg(F.sort_array(F.collect_list(F.struct("i", "l", "h"))).alias("s"))
    whole = whole.select("part", "grp", "dim", F.col("s.l").alias("lo"), F.col("s.h").alias("hi"))
    cell = lambda c: F.floor(F.get(c, F.lit(0)) / epsilon).cast("int")
    spans = whole.withColumn("from", cell("lo")).withColumn("to", cell("hi"))
    wide = spans.withColumn("cell", F.explode(F.sequence(F.col("from") - 1, F.col("to") + 1))).alias("a")
    own = spans.withColumn("cell", F.explode(F.sequence("from", "to"))).alias("b")
    met = wide.join(own, ["grp", "dim", "cell"]).where(
        (F.col("a.part") <= F.col("b.part")) & (F.col("cell") == F.greatest(F.col("a.from") - 1, F.col("b.from"))) & _near(limit, "a", "b")
    )
    parts = met.select("grp", "dim", F.col("a.part").alias("pa"), F.col("b.part").alias("pb"))
    a, b = boxes.alias("a"), boxes.alias("b")
    half = parts.alias("p").join(a, (F.col("p.pa") == F.col("a.part")) & (F.col("p.grp") == F.col("a.grp")) & (F.col("p.dim") == F.col("a.dim")))
    both = half.join(b, (F.col("p.pb") == F.col("b.part")) & (F.col("p.grp") == F.col("b.grp")) & (F.col("p.dim") == F.col("b.dim")))
    return both.where((F.col("a.block") <= F.col("b.block")) & _near(limit, "a", "b")).select(
        F.col("a.block").alias("a"), F.col("b.block").alias("b"), F.col("p.dim").alias("dim")
    )


def link(df: DataFrame, *, key: str = "vec_id", vector: str = "embedding", group: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(key, n_links, component_id, kept): one row per input row."""
    epsilon = float(np.sqrt(2 - 2 * threshold))
    unit = F.pandas_udf(lambda s: pd.Series(unit_vectors(s), dtype=object), "binary")
    rows = df.select(
        F.monotonically_increasing_id().alias("rid"), col(key).alias("k"), col(group).cast("string").alias("grp"), unit(col(vector)).alias("unit")
    ).withColumn("dim", (F.octet_length("unit") / 8).cast("int"))
    rows = materialize(rows, "unit-vectors")
    valid = rows.where("unit IS NOT NULL AND grp IS NOT NULL").select("rid", "grp", "dim", "unit")
    axes = principal_axes(valid)
    parts = max(8, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    blocks = materialize(_block_table(valid, axes, epsilon, parts), "blocks")
    pairs = materialize(_pairs(blocks, epsilon, threshold), "block-pairs")
    data = blocks.select("block", "ids", "vectors")
    named = lambda side: data.select(F.col("block").alias(side), F.col("ids").alias(f"ids_{side}"), F.col("vectors").alias(f"vectors_{side}"))
    work = pairs.join(named("a"), "a").join(named("b"), "b").repartition(parts, "a", "b")

    def compare(it):
        for pdf in it:
            for r in pdf.itertuples():
                a, b, same = _matrix([r.vectors_a], r.dim), _matrix([r.vectors_b], r.dim), r.a == r.b
                links = join_blocks(a, b, a @ axes[r.dim], b @ axes[r.dim], threshold, same)
                if not links.any():
                    continue
                ids_a, ids_b = np.asarray(r.ids_a), np.asarray(r.ids_b)
                tree = spanning_forest(links, ids_a, ids_b, same)
                yield pd.DataFrame({"x": [p[0] for p in tree], "y": pd.array([p[1] for p in tree], "Int64"), "n": pd.array([None] * len(tree), "Int64")})
                for ids, n in [(ids_a, links.sum(axis=1))] + [(ids_b, links.sum(axis=0))] * (not same):
                    yield pd.DataFrame({"x": ids[n > 0], "y": pd.array([None] * int((n > 0).sum()), "Int64"), "n": pd.array(n[n > 0], "Int64")})

    found = materialize(work.mapInPandas(compare, "x long, y long, n long"), "links")
    counts = found.where("n IS NOT NULL").groupBy("x").agg(F.sum("n").alias("n_links"))
    roots = components(found.where("y IS NOT NULL").select(F.col("x").alias("a"), F.col("y").alias("b")))
    ids = rows.select("rid", "k")
    named_roots = ids.join(roots, F.col("rid") == F.col("node")).select("rid", "k", "root")
    least = named_roots.groupBy("root").agg(F.min("k").alias("component"))
    of_vector = _join(named_roots.select("rid", "root"), least, "root").select(F.col("rid").alias("r1"), "component")
    joined = ids.join(counts, F.col("rid") == F.col("x"), "left").join(of_vector, F.col("rid") == F.col("r1"), "left")
    component = F.when(F.col("r1").isNull(), F.col("k")).otherwise(F.col("component"))
    return joined.select(
        F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.col("k").eqNullSafe(component).alias("kept"),
    )


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
