"""Secrets, BPE, SimHash, line dedup, classifiers and the pipeline against brute force and libraries."""

import base64
import gzip
import hashlib
import random
import urllib.parse
from array import array

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from reportmill.llm import bpe, line_dedup, quality_classifier, secrets, simhash, toxicity
from reportmill.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, d int, gone int, fp string"


def docs_of(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", len(t or ""), 1, 2, "x") for i, t in enumerate(texts)], SCHEMA)


# --- secrets

KEY = "AKIA" + "ABCDEFGH12345678"


def spans(text):
    return secrets.find(text)[1]


@pytest.mark.parametrize("text", [None, "", "plain words only", "token: abc", "AKIASHORT", "deadbeef"])
def test_no_secrets(text):
    assert secrets.find(text)[:2] == ([], [])


def test_base_secrets():
    text = f'é password = "hunter22!" {KEY} ' + "0123456789abcdef" * 2
    assert [(text[a:b], secrets.KINDS[k]) for a, b, k in secrets.find(text)[0]] == [
        ('password = "hunter22', "assign"), (KEY, "access"), ("0123456789abcdef" * 2, "hex"),
    ]
    assert secrets.find("password:token:abcdefgh")[0] == []  # the failing match takes its text


def wrap(kind, s):
    if kind == "url":
        return urllib.parse.quote(s, safe="")
    if kind == "all-url":
        return "".join(f"%{b:02X}" for b in s.encode())
    if kind == "unicode":
        return "".join(f"\\u{ord(c):04x}" for c in s)
    if kind == "base64":
        return base64.b64encode(s.encode()).decode()
    return base64.b64encode(gzip.compress(s.encode(), mtime=0)).decode()


@pytest.mark.parametrize("kinds", [("url",), ("all-url",), ("unicode",), ("base64",), ("gzip",), ("base64", "base64"), ("gzip", "base64", "all-url"), ("unicode", "base64"), ("base64",) * 4])
def test_nested_secrets(kinds):
    inner = f"the secret: {KEY}zz and {KEY} end"
    for k in kinds:
        inner = wrap(k, inner)
    text = f"before {inner} after"
    found = spans(text)
    assert any(k == 1 for *_, k in found)
    at = text.index(inner)
    assert all(at <= a < b <= at + len(inner) for a, b, _ in found)


def test_mapped_span_is_exact():
    text = "see " + wrap("all-url", f"x {KEY} y")
    (a, b, _) = next(s for s in spans(text) if s[2] == 1)
    assert urllib.parse.unquote(text[a:b]) == KEY
    text = "see " + wrap("base64", f"abc{KEY}abc")
    (a, b, _) = next(s for s in spans(text) if s[2] == 1)
    assert text.index("YWJj") == 4 and a >= 8 and KEY.encode() in base64.b64decode(text[a:b])


@pytest.mark.parametrize("text", ["password\\u003dabc123def", "token\\u003d9f8e7d6c", "\\u0070assword=abcdef", "token\\u{3d}9f8e7d6c", "token\\U0000003d9f8e7d6c", "\\ud83d\\ude00 token\\x3d9f8e7d6c"])
def test_escape_before_a_hex_digit(text):
    assert [(text[a:b], k) for a, b, k in spans(text)] == [(text[text.find("token") :] if "token" in text else text, 0)]
    assert secrets._escapes("\\ud83d\\ude00a")[0] == (0, 12, "\U0001f600")


def b64(raw):
    return base64.b64encode(raw).decode()


def test_streams_to_a_fixpoint():
    import zlib

    plain = f"a secret: {KEY} end".encode()
    packed = {
        "gzip in gzip": gzip.compress(gzip.compress(plain)), "zlib in gzip": gzip.compress(zlib.compress(plain)), "later member": gzip.compress(b"first part") + gzip.compress(plain),
        "over members": gzip.compress(plain[:15]) + gzip.compress(plain[15:]), "after a stream": gzip.compress(b"x" * 50) + plain, "among bytes": bytes(range(128, 160)) + zlib.compress(plain),
        "zlib twice after gzip": gzip.compress(zlib.compress(b"no") + zlib.compress(zlib.compress(plain))),
    }
    for name, raw in packed.items():
        text = f"see {b64(raw)} end"
        found = [(a, b) for a, b, k in spans(text) if k == 1]
        assert found and all(4 <= a < b <= len(text) - 4 for a, b in found), name
    assert secrets.find("see " + b64(gzip.compress(gzip.compress(b"nothing here to see at all"))))[1] == []


@pytest.mark.parametrize("glue", ["/v1/x/", "key-", "a", "ab", "abc", "/", "path/to_a-"])
def test_base64_glued_to_other_characters(glue):
    for raw in (f"my token: abcdef {KEY} ok".encode(), gzip.compress(f"my {KEY} ok".encode())):
        for tail in ("", "/tail", "-z"):
            text = f"get {glue}{b64(raw).rstrip('=')}{tail} now"
            assert any(k == 1 and a >= 4 and b <= len(text) - 4 for a, b, k in spans(text)), (glue, tail)


def test_secret_query(spark):
    texts = [f"token={'a' * 10}", None, "", f"x {KEY} " + wrap("base64", f"pass {KEY} word"), "z" * 200_000]
    found = secrets.scan_secrets(docs_of(spark, texts)).select("doc_id", "secrets.*").collect()
    assert [len(r["base"]) for r in found] == [1, 0, 0, 1, 0]
    assert [len(r["spans"]) for r in found] == [1, 0, 0, 2, 0]
    clean = [r["text"] for r in secrets.redact(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert clean[0] == "[secret]" and clean[1] is None and KEY not in clean[3]
    assert secrets.scan_secrets(docs_of(spark, texts).limit(0)).count() == 0


# --- BPE

library = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    t = library.Tokenizer.from_file(bpe.default_tokenizer())
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    with open(bpe.default_tokenizer(), encoding="utf-8") as f:
        return bpe.TrieBpe(f.read())


def same(tokenizer, own, text):
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    packed = own.encode([text])[0]
    assert array("I", packed).tolist() == ids
    assert own.decode(packed) == tokenizer.decode(ids, skip_special_tokens=False)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", exclude_categories=("Cs", "Cn", "Co")), max_size=60))
def test_any_text(tokenizer, own, text):
    same(tokenizer, own, text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abehlnorstTHE 'sdml0.,!\n", max_size=80))
def test_word_like_text(tokenizer, own, text):
    same(tokenizer, own, text)


@pytest.mark.parametrize("text", ["", " ", "a<|endoftext|>b", "<|startoftext|>", "<|endoftext", "I'LL don't 'S", "ΣΑΣ ΟΔΟΣ", "İstanbul", "é é", "x\x1cy\x85z w", "a" * 3000, "aaaa bbbb" * 50, "😀👍🏽", "ﬁ½ß"])
def test_special_text(tokenizer, own, text):
    same(tokenizer, own, text)


def test_small_memory_changes_no_ids(tokenizer, own, monkeypatch):
    """With generations of a few entries, words come back from the old one or are worked out again."""
    monkeypatch.setattr(bpe, "REMEMBERED", 8_000)
    monkeypatch.setattr(bpe, "TESTS", 20)
    r = random.Random(9)
    words = ["".join(r.choice("abehlnorst") for _ in range(r.randint(1, 9))) for _ in range(60)]
    for _ in range(40):
        same(tokenizer, own, " ".join(r.choice(words) for _ in range(30)))
    assert own.old_chunks and own.old_fits and own.held <= 8_000


def test_bpe_query(spark, tokenizer):
    texts = ["Hello world, it's 2024!", None, "", "long " * 50_000]
    got = {r["doc_id"]: r for r in bpe.digests(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()


# --- SimHash


def test_golay_keys_meet():
    r = random.Random(3)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), r.randint(0, 2)):
            b ^= 1 << bit
        fps = np.array([a, b], np.uint64).view(np.int64)
        who, key = simhash.keys(fps)
        assert set(key[who == 0]) & set(key[who == 1])


def roots(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 200), r.randrange(100, 200)) for _ in range(60)] + [(300, x) for x in range(301, 350)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(400, edges)
    assert got == {n: want[n] for e in edges for n in e if e[0] != e[1] or n in got}


def brute_fingerprint(text):
    import xxhash

    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts():
    r = random.Random(6)
    base = [" ".join(r.choice(["ab", "cd", "ef", "gh"]) + str(r.randint(0, 999)) for _ in range(300)) for _ in range(40)]
    out = [None, "", "One two", "one TWO", " "] + base + base[:5] + base[:3]
    for t in base[:12]:
        w = t.split()
        for k in range(4):
            w[10 + 50 * k] = "changed"
            out.append(" ".join(w))
    return out


def test_simhash(spark):
    texts = near_texts()
    got = simhash.near_duplicates(docs_of(spark, texts)).collect()
    fps = [brute_fingerprint(t) for t in texts]
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{f:016x}" for i, f in enumerate(fps)}
    n = len(texts)
    want = roots(n, [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert {r["doc_id"]: r["component_id"] for r in got} == dict(enumerate(want))
    kept = simhash.keep_one(docs_of(spark, texts).unionByName(docs_of(spark, texts[:8])))
    assert kept.columns == docs_of(spark, []).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))
    assert simhash.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def test_simhash_large_bucket(spark, monkeypatch):
    r = random.Random(8)
    centre = r.getrandbits(64)
    fps = list({centre ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 2))) for _ in range(400)} | {r.getrandbits(64) for _ in range(50)})
    monkeypatch.setattr(simhash, "BLOCK", 16)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = [(x["a"], x["b"]) for x in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    at = {f: i for i, f in enumerate(signed)}
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2])
    assert roots(len(fps), [(at[a], at[b]) for a, b in edges]) == want


def word_sets(text, width=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + width]) for i in range(max(len(words) - width, 0) + 1)} if words else set()


def replaced(r, text, k):
    words = text.split()
    for i in r.sample(range(len(words)), k):
        words[i] = f"new{r.randint(0, 9999)}"
    return " ".join(words)


def test_near_copies_by_similarity(spark):
    r = random.Random(12)
    base = [" ".join(f"w{r.randint(0, 999)}" for _ in range(300)) for _ in range(30)]
    texts = [*base, *(replaced(r, t, k) for t in base for k in (1, 3, 5, 6, 7, 9, 20)), "One two", "one TWO", "one two three", None, "", " "]
    texts += [" ".join(base[0].split()[:200] + base[i].split()[:100]) for i in range(1, 12)]  # a shared passage, no near copies
    sets = [word_sets(t) for t in texts]
    n = len(texts)
    near = [(i, j) for i in range(n) for j in range(i) if sets[i] == sets[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    kept = sorted(x["doc_id"] for x in corpus_pipeline.simhash_stage(spark, docs_of(spark, texts), "").collect())
    assert kept == sorted(set(roots(n, near)))
    assert corpus_pipeline.simhash_stage(spark, docs_of(spark, texts).limit(0), "").count() == 0


def test_wide_fingerprint_is_a_simhash_whose_soft_golay_keys_meet():
    r = np.random.default_rng(7)
    one, two = [], []
    for _ in range(400):  # pairs at exactly 0.8
        h = r.integers(0, 2**64, 100, dtype=np.uint64)
        one.append(h[:90])
        two.append(np.r_[h[:80], h[90:]])
    sums = [np.stack([simhash.wide_sums(x) for x in sets]) for sets in (one, two)]
    for x, s in zip(one[:20], sums[0], strict=False):
        assert (s[:64] > 0).tolist() == [2 * sum(int(h) >> b & 1 for h in x) > len(x) for b in range(64)]
    keys = [[set(k) for k in simhash.soft_keys(s).tolist()] for s in sums]
    assert all(a & b for a, b in zip(*keys, strict=True))
    assert ((sums[0][:, :128] > 0) != (sums[1][:, :128] > 0)).sum(axis=1).max() <= simhash.WIDE_BITS


@pytest.mark.parametrize("block", [4, 1024])
def test_close_fingerprints_of_a_key(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    low = lambda n: (1 << n) - 1
    rows = [(1, 0, 0, [5]), (2, low(44), 0, [5]), (3, 0, low(45), [5]), (4, 0, 0, [6])]  # 44 and 45 bits away
    rows += [(100 + i, 7 << 40 | 1 << i, 0, [9]) for i in range(30)]  # all close
    got = simhash.close_fingerprints(spark.createDataFrame(rows, "fp long, f0 long, f1 long, keys array<int>")).collect()
    pairs, members = {(x["a"], x["b"]) for x in got if x["key"] < 0}, {(x["key"], x["a"]) for x in got if x["key"] >= 0}
    assert {p for p in pairs if p[0] < 100} == {(1, 2)}
    assert {k for k, _ in members} == {9}
    assert all((9, f) in members or any(f in p for p in pairs) for f in range(100, 130))


@pytest.mark.parametrize(("block", "whole"), [(1024, 16), (32, 16), (1024, 0), (32, 0)])
def test_a_large_group_of_close_texts_is_not_listed_in_pairs(spark, monkeypatch, block, whole):
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "WHOLE", whole, raising=False)
    r, made, join = random.Random(16), [], simhash._join

    def counted(left, right, on):
        made.append(join(left, right, on).count())
        return join(left, right, on)

    base = " ".join(f"w{r.randint(0, 999)}" for _ in range(120))
    texts = [base, *(replaced(r, base, r.randint(2, 6)) for _ in range(250)), *(" ".join(f"v{r.randint(0, 999)}" for _ in range(50)) for _ in range(20))]
    sets, n = [word_sets(t) for t in texts], len(texts)
    want = roots(n, [(i, j) for i in range(n) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])])
    if block == 1024 and whole:
        monkeypatch.setattr(simhash, "_join", counted)
    kept = sorted(x["doc_id"] for x in corpus_pipeline.simhash_stage(spark, docs_of(spark, texts), "").collect())
    assert kept == sorted(set(want)) and len(kept) > 30
    assert max(made, default=0) <= 2 * n


# --- line dedup


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        p, op = r.randrange(len(s)), r.randrange(3)
        if op == 0:
            s[p] = "#"
        elif op == 1:
            s.insert(p, "#")
        else:
            del s[p]
    return "".join(s)


@pytest.mark.parametrize("tau", [1, 2, 3])
def test_edit_distance_and_keys(tau):
    r = random.Random(tau)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(12, 40)))
        b = edited(r, a, r.randint(0, tau + 2))
        close = line_dedup._plain(a, b) <= tau
        assert line_dedup.within(a, b, tau) == close
        if close and len(b) > tau:
            long, short = (a, b) if len(a) >= len(b) else (b, a)
            assert {k for part in line_dedup.keys(long, tau) for k in part} & set(line_dedup.keys(short, tau)[0])


def brute_lines(docs, tau=2, least=30, share=None):
    """Lines that stay, by the definitions."""
    found = [(i, k, x, t) for i, t in docs if t is not None for k, x in enumerate(t.split("\n")) if len(x) >= 12 and x.strip(" \t\n\v\f\r")]
    first = {}
    for i, k, x, _ in found:
        first[x] = min(first.get(x, (i, k)), (i, k))
    near = lambda x, y: x == y or (min(len(x), len(y)) >= least and abs(len(x) - len(y)) <= tau and line_dedup._plain(x, y) <= tau)
    source = {x: min(p for y, p in first.items() if near(x, y)) for x in first}
    gone = set()
    for i, t in docs:
        mine = [(k, x, source[x]) for j, k, x, _ in found if j == i and source[x] < (j, k)]
        held = {}
        for _, x, s in mine:
            if s[0] != i:
                held[s[0]] = held.get(s[0], 0) + len(x)
        gone |= {(i, k) for k, x, s in mine if s[0] == i or share is None or held[s[0]] <= share * len(t)}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}


def line_docs():
    r = random.Random(9)
    line = lambda: " ".join(r.choice(["red", "green", "blue", "black"]) + str(r.randint(0, 9999)) for _ in range(r.randint(4, 9)))
    shared = [line() for _ in range(6)]
    texts = [None, "", "\n\n", "short\nshort"]
    for _ in range(40):
        parts = [line() for _ in range(r.randint(4, 8))]
        if r.random() < 0.7:
            parts.insert(r.randrange(len(parts)), edited(r, r.choice(shared), r.randint(0, 3)))
        if r.random() < 0.2:
            parts.append(parts[0])
        if r.random() < 0.3:
            parts.insert(1, r.choice(["All rights reserved.", "All rights reserve.", "\u00a0" * 40, "Yes."]))
        texts.append("\n".join(parts))
    copy = texts[10]
    lines = copy.split("\n")
    lines[1] = line()
    return texts + [copy, "\n".join(lines), copy]


def test_keys_meet_over_batches():
    import pandas as pd

    r = random.Random(11)
    rows = sorted({(k, (r.randrange(1, 5) << 1) | r.randrange(2)) for k in range(60) for _ in range(r.randint(1, 6))}, key=lambda x: (x[0], x[1] & 1))
    want = set()
    for k in range(60):
        run = [c for key, c in rows if key == k]
        if any(not c & 1 for c in run) and len({c >> 1 for c in run}) > 1:
            want |= {(k, c) for c in run}
    for size in (1, 2, 3, 7, 1000):
        batches = [pd.DataFrame(rows[i : i + size], columns=["key", "c"]) for i in range(0, len(rows), size)]
        got = [tuple(map(int, x)) for pdf in line_dedup._meeting(iter(batches)) for x in pdf.to_numpy()]
        assert set(got) == want


@pytest.mark.parametrize(("block", "share"), [(512, None), (2, None), (512, 0.5)])
def test_line_dedup(spark, monkeypatch, block, share):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    texts = line_docs()
    docs = docs_of(spark, texts)
    got = line_dedup.dedup(docs, dropped="n_dropped", copy_share=share)
    assert got.columns == [*docs.columns, "n_dropped"]
    rows = {r["doc_id"]: r for r in got.collect()}
    want = brute_lines(list(enumerate(texts)), share=share)
    assert {i: r["text"] for i, r in rows.items()} == want
    assert sum(r["n_dropped"] for r in rows.values()) > 10
    assert line_dedup.dedup(docs.limit(0)).count() == 0


def test_hot_line(spark):
    common = "this very line is found in each and every document"
    r = random.Random(7)
    own = lambda: " ".join(f"word{r.randint(0, 99999)}" for _ in range(12))
    texts = [f"{common}\n{own()}\n{own()}" for _ in range(80)]
    kept = [r["text"] for r in line_dedup.dedup(docs_of(spark, texts)).orderBy("doc_id").collect()]
    assert kept[0] == texts[0] and all(common not in t for t in kept[1:])


def test_lines_are_split_once_and_their_keys_sorted_by_one_number(spark):
    docs = docs_of(spark, line_docs())
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan(line_dedup.duplicates(docs))  # reads what was written of the lines
    dealt = line_dedup._sorted_keys(docs, "text", line_dedup.MIN_CHARS, line_dedup.DISTANCE)
    assert "Sort [key#" in plan(dealt) and "ASC NULLS FIRST]" in plan(dealt).split("Sort [key#")[1].split("\n")[0].split(",")[0]
    got = dealt.rdd.glom().map(lambda part: [(r["key"], r["c"]) for r in part]).collect()
    assert sum(map(len, got)) > 100 and all(k & 1 == c & 1 for part in got for k, c in part)
    assert all(part == sorted(part, key=lambda r: r[0]) for part in got)
    where = [{k >> 1 for k, _ in part} for part in got]
    assert sum(map(len, where)) == len(set().union(*where))  # index and probes of a key are in one part


@pytest.mark.parametrize("few", [64, 0])
def test_repeats_inside_a_text(monkeypatch, few):
    monkeypatch.setattr(line_dedup, "FEW_LINES", few)
    r = random.Random(13)
    for _ in range(60):
        lines = [" ".join(r.choice(["red", "green", "blue"]) + str(r.randint(0, 9999)) for _ in range(r.randint(3, 6))) for _ in range(8)]
        lines += [edited(r, r.choice(lines), r.randint(0, 4)) for _ in range(8)] + ["short", " " * 40]
        r.shuffle(lines)
        long = [(k, x) for k, x in enumerate(lines) if len(x) >= 12 and x.strip()]
        want = [k for k, x in long if any(j < k and (x == y or (min(len(x), len(y)) >= 30 and line_dedup._plain(x, y) <= 2)) for j, y in long)]
        assert line_dedup.repeats("\n".join(lines)) == want


def test_copy_of_a_text_with_a_repeated_line(spark):
    r = random.Random(14)
    line = lambda: " ".join(f"word{r.randint(0, 99999)}" for _ in range(12))
    a, b = line(), line()
    text = f"{a}\n{b}\n{a}\n{edited(r, b, 2)}"
    clean = line_dedup.dedup(docs_of(spark, [text, line(), text, text]), dropped="n_dropped", copy_share=0.5).orderBy("doc_id").collect()
    assert [x["text"] for x in clean if x["doc_id"] != 1] == [f"{a}\n{b}"] * 3
    kept = simhash.keep_one(corpus_pipeline.line_stage(spark, docs_of(spark, [text, line(), text, text]), ""))
    assert sorted(x["doc_id"] for x in kept.collect()) == [0, 1]


def test_only_true_copies_keep_their_lines(spark, tmp_path):
    r = random.Random(15)
    line = lambda: " ".join(f"word{r.randint(0, 99999)}" for _ in range(12))
    first = [line() for _ in range(20)]
    own = [line() for _ in range(12)]
    texts = ["\n".join(first), "\n".join(first), "\n".join(first[:19] + own[:1]), "\n".join(first[:14] + own[1:7]), "\n".join(first[3:7] + own[7:9])]
    want = [texts[0], texts[1], texts[2], "\n".join(own[1:7]), "\n".join(own[7:9])]
    docs_of(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    got = line_dedup.op7_line_dedup(spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [x["n_dropped"] for x in got] == [0, 20, 19, 14, 4]  # by itself the operator exempts nothing
    stage = corpus_pipeline.line_stage(spark, docs_of(spark, texts), "")
    assert [x["text"] for x in stage.orderBy("doc_id").collect()] == want
    assert [x["doc_id"] for x in corpus_pipeline.simhash_stage(spark, stage, "").orderBy("doc_id").collect()] == [0, 3, 4]


# --- classifiers


def test_counterfactuals_move_no_score():
    r = random.Random(1)
    rows = []
    for i in range(400):
        toxic = i % 4 == 0
        words = {f"w{r.randint(0, 200)}" for _ in range(20)}
        if toxic:
            words |= {r.choice(["nasty", "vile"])}
        if r.random() < (0.8 if toxic else 0.05):
            words |= {"muslim"}
        rows.append((int(toxic), sorted(words)))
    fair, plain = toxicity.fit(rows), toxicity.fit(rows, fairness=0.0)
    gap = lambda m: abs(m["weights"].get("muslim", 0.0) - m["weights"].get("christian", 0.0))
    assert gap(fair) < 0.1 * gap(plain)
    assert toxicity.score_text(fair, "a muslim neighbour") < 0.5 < toxicity.score_text(fair, "you are vile")
    assert toxicity.fit([]) == {"bias": 0.0, "weights": {}}


def test_texts_that_name_both_groups_have_no_copy():
    rows = [(i % 2, ["muslim", "christian", f"w{i % 7}", "vile" if i % 2 else "fine"]) for i in range(60)]
    model = toxicity.fit(rows, groups=(("muslim", "christian"),))
    assert toxicity.score_text(model, "muslim christian vile") > 0.5 > toxicity.score_text(model, "muslim christian fine")
    assert toxicity.score_text(model, "une mosquée vile") > 0.5


CLASH = "doc_id long, text string, score string, statistics string, ids string, n_tokens string, decoded string, secrets string, shard string, slot string, fingerprint string, n_dropped int"


def test_clashing_names_empty_tables_and_long_texts(spark):
    mixed = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    long = "\n".join(f"{mixed(i)[:12]} {mixed(i)[12:24]} {mixed(i)[24:36]}" for i in range(2000))
    docs = spark.createDataFrame([(1, long, *["x"] * 9, 5), (None, None, *["y"] * 9, 6), (2, "", *["z"] * 9, 7), (1, long, *["x"] * 9, 5)], CLASH)
    none, labels = docs.limit(0), spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, labels)
    made = {
        "toxicity": lambda d: toxicity.score(d, model), "secrets": secrets.scan_secrets, "fingerprint": simhash.with_fingerprint, "line_dedup": lambda d: line_dedup.dedup(d, dropped="n_gone"),
        "encode": lambda d: bpe.encode(d, bpe.default_tokenizer()), "statistics": quality_classifier.with_statistics,
    }
    for name, f in made.items():
        got = f(docs)
        assert got.columns[: len(docs.columns)] == docs.columns, name
        rows = got.collect()
        assert len(rows) == 4 and sorted(r["score"] for r in rows) == ["x", "x", "y", "z"], name
        assert f(none).count() == 0, name
    assert bpe.digests(none).count() == 0 and simhash.near_duplicates(docs).count() == 4


def labelled(spark):
    r = random.Random(2)
    texts, rows = [], []
    for i in range(600):
        bad = i % 3 == 0
        words = [f"word{r.randint(0, 500)}" + ("%%%" if bad else "") for _ in range(r.randint(20, 120))]
        texts.append(" ".join(words) + (" horrid" if i % 5 == 0 else ""))
        rows.append((i, int(not bad), int(i % 5 == 0)))
    rows += [(None, 1, 1), (3, None, None)]
    return docs_of(spark, [*texts, None, ""]), spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_classifiers_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    truth = {r["doc_id"]: r for r in labels.collect() if r["doc_id"] is not None and r["quality"] is not None}
    held = {r["doc_id"] for r in docs.where(toxicity.held_out(docs["doc_id"])).collect()}
    scored = {r["doc_id"]: r["score"] for r in quality_classifier.classify(docs, labels).collect()}
    assert len(scored) == docs.count() and all(0 <= s <= 1 for s in scored.values())
    tested = [i for i in held if i in truth]
    assert np.mean([(scored[i] >= 0.3) == truth[i]["quality"] for i in tested]) > 0.95
    model = toxicity.train(docs, labels)
    tox = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert np.mean([(tox[i] >= 0.5) == truth[i]["toxic"] for i in tested]) > 0.95


def test_classifiers_without_labels(spark):
    docs, labels = labelled(spark)
    none = labels.limit(0)
    assert {r["score"] for r in quality_classifier.classify(docs, none).collect()} == {0.5}
    assert toxicity.train(docs, none) == {"bias": 0.0, "weights": {}}
    assert quality_classifier.classify(docs.limit(0), labels).count() == 0


# --- pipeline


def test_pipeline_stages(spark, tmp_path):
    r = random.Random(12)
    line = lambda: " ".join(f"{r.choice(['stone', 'river', 'cloud', 'field'])}{r.randint(0, 9999)}" for _ in range(25))
    texts = ["\n".join(line() for _ in range(5)) for _ in range(60)]
    texts += texts[:10] + [None, "", "too short"] + [" ".join(["spam%%%"] * 60)]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now
        if name != "bpe":
            assert now.columns == docs.columns
    ids = lambda n: sorted(x["doc_id"] for x in seen[n].select("doc_id").collect())
    assert ids("quality_rules") == list(range(70))
    assert ids("line_dedup") == list(range(70))
    assert ids("simhash") == list(range(60))
    assert set(ids("mixing")) <= set(range(60)) and len(ids("mixing")) > 30
    assert ids("bpe") == ids("mixing")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen["bpe"].count()


def test_pipeline_of_nothing(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long, lines_taken int, rank string"
    for name, rows in {"empty": [], "rejected": [(1, None, "en", "a", 0, 1, "x"), (1, "short", "en", "a", 5, 1, "x"), (1, "short", "en", None, 5, 1, "x")]}.items():
        spark.createDataFrame(rows, kind).write.parquet(str(tmp_path / name / "documents.parquet"))
        assert corpus_pipeline.run(spark, str(tmp_path / name)).count() == 0
