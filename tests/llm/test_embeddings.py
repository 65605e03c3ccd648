"""The grid order join against all pairs."""

import numpy as np
import pytest

from reportmill.llm import embedding_dedup as E


def table(spark, seed=1):
    r = np.random.default_rng(seed)
    rows, n = [], 0
    for label in (0, 1, None):
        centres = r.normal(size=(12, 16))
        for c in centres:
            for _ in range(r.integers(1, 12)):
                rows.append((n, (c + r.normal(scale=r.choice([0.02, 0.12, 0.5]), size=16)).astype(np.float32).tolist(), label))
                n += 1
    rows += [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * 16, 0), (n + 3, [float("nan")] * 16, 0), (n + 4, [1.0, None] * 8, 0), (n + 5, [float("inf")] + [0.0] * 15, 0)]
    rows += [(n + 6, rows[0][1], 0), (n + 7, rows[0][1], 1), (n + 8, [1.0, 2.0], 0), (n + 9, [2.0, 4.0], 0)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def brute(rows, threshold=0.93):
    ok = [(i, np.array(v, float), g) for i, v, g in rows if v and g is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, *_ in rows}
    for a, (i, x, g) in enumerate(ok):
        for j, y, h in ok[:a]:
            if g == h and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i].add(j)
                links[j].add(i)
    out = {}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            new = links[todo.pop()] - seen
            seen |= new
            todo += new
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


@pytest.mark.parametrize(("block", "leaf"), [(1024, 128), (16, 4), (3, 1)])
def test_all_links(spark, monkeypatch, block, leaf):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "LEAF", leaf)
    rows, df = table(spark)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in E.link(df).collect()}
    want = brute(rows)
    assert sum(n for n, *_ in want.values()) > 50
    assert got == want


def test_empty_table(spark):
    assert E.link(table(spark)[1].limit(0)).count() == 0
