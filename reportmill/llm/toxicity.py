"""Toxicity: a counterfactual-regularised classifier of whole texts.

A logistic model on the presence of words. Each labelled text that names a group is paired with
copies that name another group instead; differences between the scores of a text and its copies are
penalised, so a group's name alone moves no score and a neutral mention is no false positive.

The model is fitted on a bounded sample of labelled rows: the ``per_class`` rows of each class that
come first by a hash of their id. Words that tell the classes apart by at least ``z_min`` standard
errors become features. The fitted model is a dictionary of a few words, sent to the executors.

Defined results: null and empty texts get the score of a text without any known word; texts are read
whole however long; repeated rows get equal scores; a label that is null is no label, and of several labels
of an id the largest counts, of several texts of a labelled id the one whose hash is least; without any label
of one class all scores are 0.5; an empty table gives an empty table; other columns pass through, whatever
their names. A text that already names both groups has no such copy: swapping them gives the same words.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.llm.common import col, documents, fresh

#: Fixed lists of terms that name groups of people, by kind and language; terms of a kind are swapped for each other.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "nonbinary"),
    ("woman", "man", "girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "indigenous"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("disabled", "deaf", "blind", "elderly", "young"),
    ("femmes", "hommes", "filles", "garçons"),
    ("musulmans", "chrétiens", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes"),
    ("immigrés", "réfugiés", "étrangers"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("muslime", "christen", "juden", "hindus", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber"),
    ("einwanderer", "flüchtlinge", "ausländer"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes"),
    ("inmigrantes", "refugiados", "extranjeros"),
)
TOKEN = re.compile(r"[^\W\d_]+")
#: Labelled rows of each class that the model is fitted on, at most.
PER_CLASS = 3000


def tokens(text: str | None) -> set[str]:
    return set(TOKEN.findall(text.lower())) if text else set()


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, *, text: str, key: str, label: str, per_class: int) -> DataFrame:
    """(label, words) of the bounded sample."""
    usable = labels.where(col(label).isin(0, 1) & ~held_out(col(key))).groupBy(col(key).alias("k")).agg(F.max(col(label)).alias("y"))
    order = F.md5(F.col("k").cast("string"))
    chosen = [usable.where(F.col("y") == y).orderBy(order, "k").limit(per_class) for y in (0, 1)]
    sample = chosen[0].unionByName(chosen[1])  # at most 2 * per_class rows
    words = F.pandas_udf(lambda s: s.map(lambda t: " ".join(sorted(tokens(t)))), "string")
    found = docs.select(col(key).alias("k2"), col(text).alias("t")).join(F.broadcast(sample), F.col("k2") == F.col("k"))
    one = found.groupBy("k", "y").agg(F.min(F.struct(F.xxhash64("t").alias("h"), "t"))["t"].alias("t"))
    return one.select("k", "y", words("t").alias("words"))


def fit(rows: list[tuple[int, list[str]]], *, groups=IDENTITY_TERMS, z_min: float = 5.0, l2: float = 1e-3, fairness: float = 10.0, steps: int = 300) -> dict:
    """Fits the model to (label, distinct words) rows: {"bias": b, "weights": {word: w}}."""
    n = Counter(y for y, _ in rows)
    if not n[0] or not n[1]:
        return {"bias": 0.0, "weights": {}}
    seen = (Counter(), Counter())
    for y, words in rows:
        seen[y].update(words)
    terms: dict[str, tuple[str, ...]] = {}
    for g in groups:  # a term of two languages is swapped within both
        for t in g:
            terms[t] = tuple(dict.fromkeys(terms.get(t, ()) + g))

    def z(w: str) -> float:
        p0, p1 = (seen[0][w] + 0.5) / (n[0] + 1), (seen[1][w] + 0.5) / (n[1] + 1)
        p = (seen[0][w] + seen[1][w] + 1) / (n[0] + n[1] + 2)
        return abs(p1 - p0) / np.sqrt(p * (1 - p) * (1 / (n[0] + 1) + 1 / (n[1] + 1)))

    every = {w for w in {*seen[0], *seen[1]} if seen[0][w] + seen[1][w] >= 5}
    strength = {w: z(w) for w in every}
    chosen = [w for w in sorted(every) if strength[w] >= z_min] or sorted(every, key=lambda w: (-strength[w], w))[:64]
    chosen = sorted({*chosen, *(t for t in terms if t in seen[0] or t in seen[1])})
    at = {w: i for i, w in enumerate(chosen)}
    for t in terms:  # swapped-in terms need a weight, too
        at.setdefault(t, len(at))
    docs, cols, y = [], [], np.array([a for a, _ in rows], float)
    gone, come = [], []
    for i, (_, found) in enumerate(rows):
        words = dict.fromkeys(found)
        for w in words:
            if w in at:
                docs.append(i)
                cols.append(at[w])
                if w in terms:  # a counterfactual copy for each other term of its kind
                    others = [o for o in terms[w] if o not in words]
                    gone += [at[w]] * len(others)
                    come += [at[o] for o in others]
    docs, cols, gone, come = (np.array(a, int) for a in (docs, cols, gone, come))
    balance = np.where(y == 1, 0.5 / n[1], 0.5 / n[0])
    w, b = np.zeros(len(at)), 0.0
    m, v = np.zeros(len(at) + 1), np.zeros(len(at) + 1)
    for step in range(1, steps + 1):
        s = b + np.bincount(docs, w[cols], len(y))
        r = balance * (1 / (1 + np.exp(-s)) - y)
        g = np.bincount(cols, r[docs], len(at)) + l2 * w
        if len(gone):
            d = (w[gone] - w[come]) * (2 * fairness / len(gone))
            g += np.bincount(gone, d, len(at)) - np.bincount(come, d, len(at))
        g = np.append(g, r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    return {"bias": float(b), "weights": {t: float(w[i]) for t, i in at.items() if abs(w[i]) > 1e-6}}


def score_text(model: dict, text: str | None) -> float:
    weights = model["weights"]
    s = model["bias"] + sum(weights[w] for w in sorted(weights.keys() & tokens(text)))
    return float(1 / (1 + np.exp(-np.clip(s, -500, 500))))


def score(docs: DataFrame, model: dict, *, text: str = "text", name: str = "score") -> DataFrame:
    """Adds the score of each whole text."""
    (out,) = fresh(docs, name)

    def scores(s: pd.Series) -> pd.Series:
        return s.map(lambda t: score_text(model, t)).astype("float64")

    return docs.withColumn(out, F.pandas_udf(scores, "double")(col(text)))


def train(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "toxic", per_class: int = PER_CLASS, **options) -> dict:
    """The model, fitted on labelled rows that are not held out."""
    rows = training_rows(docs, labels, text=text, key=key, label=label, per_class=per_class).toLocalIterator()
    return fit([(y, words.split()) for _, y, words in sorted(rows)], **options)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score(docs, model)
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
