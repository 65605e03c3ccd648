"""Mixing, quality rules and sharding against brute force, with edge cases."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reportmill.llm import mixing, quality_rules, sharding
from reportmill.llm.common import prepare

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `s1` int, `kept` string, `vote_key` int"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out = []
    for i in range(400):
        n = r.choice([0, 1, 5, 30, 60, 200])
        words = [r.choice(["alpha", "bravo", "charlie", "delta,", "echo.", "über", "x#"]) + str(r.randint(0, 99)) for _ in range(n)]
        text = "".join(w + r.choice([" ", " ", "\n", "\t", "  "]) for w in words)
        out.append((i, text, "en", r.choice(["a", "a", "a", "b", "c", None, "é"]), len(text), 1, "k", 2))
    out += [(None, None, None, None, None, None, None, None), (400, "", None, "b", 0, 1, "", 1), (1, out[1][1], "en", out[1][3], 3, 1, "k", 2)]
    phrase = "one two three four five six seven eight nine ten "
    out += [(500, phrase * 4, "en", "a", 1, 1, "k", 2), (501, phrase * 2 + "tail " * 3, "en", "a", 1, 1, "k", 2), (502, "line one here\nline one here\n\nother", "en", "a", 1, 1, "k", 2)]
    return out


def targets(sizes: dict) -> dict:
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in capped]
        rest = total - sum(capped.values())
        share = {s: rest * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 3.0 * sizes[s] for s in over}


def test_mixing(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    sized = docs.withColumn("size", mixing.n_words(F.col("text")))
    got = [r.asDict() for r in mixing.assign_copies(sized, size="size").collect()]
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, _, s, *_ in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken, top = targets(sizes), defaultdict(int), defaultdict(int)
    for g in got:
        assert g["size"] == len(WORD.findall(g["text"] or ""))
        assert g["target"] == pytest.approx(want[g["source"]])
        assert 0 <= g["copies"] <= 3
        taken[g["source"]] += g["copies"] * g["size"]
        top[g["source"]] = max(top[g["source"]], g["size"])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 2 * top[s] + 0.05 * want[s]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(g["copies"] for g in got)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))
    assert mixing.mix(docs.limit(0)).count() == 0


def statistics(text):
    words = WORD.findall(text or "")
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i : i + 8])].append(i)
    covered = {p + k for at in seen.values() if len(at) > 1 for p in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    got = quality_rules.judge(docs.select("doc_id", "text"), carry=["doc_id", "text"]).collect()
    assert len(got) == len(rows)
    for r in got:
        want = statistics(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["kept"] and r["base_failed"])
        assert 0 <= r["posterior"] <= 1
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["kept"] for r in got)
    assert quality_rules.keep_good(docs.limit(0)).count() == 0


def test_rules_learn_which_votes_count(spark):
    good = [(i, " ".join(f"word{i}x{k}" for k in range(80))) for i in range(150)]
    bad = [(1000 + i, " ".join(f"w{i}x{k}%%%" for k in range(80))) for i in range(30)]
    got = {r["doc_id"]: r["kept"] for r in quality_rules.judge(spark.createDataFrame(good + bad, "doc_id long, text string")).collect()}
    assert all(got[i] for i, _ in good) and not any(got[i] for i, _ in bad)


def test_sharding(spark, rows):
    docs = spark.createDataFrame([r for r in rows if r[0] is None or r[0] < 402] + [(600 + i, "same text again " * 5, "en", "a", 1, 1, "k", 2) for i in range(150)], SCHEMA)
    got = sharding.shard(docs).collect()
    assert len(got) == docs.count()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append(r)
    assert set(by) == set(range(24))
    for part in by.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    sums = [sum(r["size"] for r in p) for p in by.values()]
    assert max(sums) - min(sums) <= 0.25 * sum(sums) / 24 + 2 * max(r["size"] for r in got)
    where = defaultdict(set)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in got:
        where[texts[r["doc_id"]]].add(r["shard"])
    counts = Counter(texts.values())
    split = [t for t, s in where.items() if len(s) > 1]
    total = sum(sums)
    assert all(counts[t] * (len((t or "").encode()) + 8) > total / 24 / 40 or counts[t] > len(got) / 24 / 40 for t in split)
    assert sharding.shard(docs.limit(0)).count() == 0


def test_sharding_writes_every_row(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA).where("doc_id < 400").dropDuplicates(["doc_id"])
    sharding.write_shards(prepare(spark).createDataFrame(docs.collect(), docs.schema), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == docs.count()
