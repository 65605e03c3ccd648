"""Column text functions against plain Python."""

import random
import re
import time

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reportmill.functions import clauses as C
from reportmill.functions import text as X
from reportmill.operators import labelling as L

SAMPLES = ["", " ", "Ünïcödé  ﬁ ½", "ıİßđĐøØæÆł", "a_b/c\\d", "x–y—z-‑w", "tab\t\there\n next ", "ΆΈ ώ й", "soft­hyphen", "Ⅳ grade ²"]


def column(spark, texts, f):
    return [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v")).orderBy("i").select("v").collect()]


def test_normalize(spark):
    assert column(spark, SAMPLES, X.normalize) == [C.normalize_text(t) for t in SAMPLES]
    assert column(spark, [None], X.normalize) == [""]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="aéÉßüñçœ-_/ \n.,ıΣάж", max_size=30), min_size=20, max_size=40))
def test_normalize_more(spark, texts):
    assert column(spark, texts, X.normalize) == [C.normalize_text(t) for t in texts]


def test_normalize_in_one_pass(spark):
    assert column(spark, ["a _-–/ b ", "x \u0085", "\x0b\f a\n"], X.normalize) == ["a b", "x \u0085", "a"]  # as in SQL, a blank before another line end stays
    sql = str(X.normalize(F.col("t")))
    assert "regexp_extract_all" not in sql and sql.count("regexp_replace") == 1
    every = [chr(i) for i in range(1, 0x11000) if not 0xD800 <= i < 0xE000]
    texts = ["".join(every[i : i + 64]) for i in range(0, len(every), 64)]
    plain = column(spark, texts, X.fold_marks)
    assert column(spark, plain, X.fold_marks) == plain


def test_spans(spark):
    texts = ["the cat and the dog", "", "other theme", "the", "the  cat, the cat"]
    found = column(spark, texts, lambda c: X.spans(c, X.term_pattern(("the cat", "the"))))
    want = [[(m.start(), m.end(), m[0]) for m in re.finditer(r"(?<!\w)(?:the\s+cat|the)(?!\w)", t)] for t in texts]
    assert [[tuple(x) for x in f] for f in found] == want


def test_spans_of_many_matches(spark):
    texts = ["the " * n for n in (1, 16, 17, 255, 256, 257, 4096, 4097)] + ["the cat\n" * 20000]
    pattern = r"(?U)(?<!\w)(?:the|cat)(?!\w)"
    began = time.time()
    found = column(spark, texts, lambda c: X.merge_spans(X.spans(c, pattern), X.spans(c, X.term_pattern(("the",)))))
    want = [[(m.start(), m.end(), m[0]) for m in re.finditer(r"\b(?:the|cat)\b", t)] for t in texts]
    assert [[tuple(x) for x in f] for f in found] == want
    assert time.time() - began < 60  # minutes when work grows with the square of the matches
    assert column(spark, [None], lambda c: X.merge_spans(X.spans(c, pattern), X.spans(c, "the"))) == [None]


def test_language(spark):
    texts = [C.normalize_text(t) for t in ["Findings: no evidence of tear in the knee.", "", "χιαστός σύνδεσμος", "связки целы", "xyz", "Befund: kein Erguss, und die Menisken sind intakt"]]
    assert column(spark, texts, X.language_group) == [C.language(t) for t in texts]
    assert column(spark, texts, X.language_hypotheses) == [C.hypotheses(t) for t in texts]


def test_line_join(spark):
    r = random.Random(3)
    lines = ["Long line without any end that goes on", "short", "ends with comma,", "next part.", "", "  indented text that is long enough to be joined", "Upper"]
    texts = ["\n".join(r.choice(lines) for _ in range(6)) for _ in range(60)]
    assert column(spark, texts, L.joined_lines) == [C.join_wraps(t) for t in texts]


def test_grams_and_similarity(spark):
    assert column(spark, ["a b c", "a", ""], lambda c: X.ngrams(X.tokens(c), 2)) == [["a b", "b c"], [], []]
    assert column(spark, ["a b"], lambda c: X.jaccard(X.tokens(c), F.array(F.lit("b"), F.lit("c")))) == [1 / 3]
    assert column(spark, [""], lambda c: X.jaccard(X.tokens(c), X.tokens(c))) == [1.0]
