"""Quality classifier: regularised quadratic discriminant analysis of text statistics.

Each whole text becomes a vector of transformed statistics. For each class the mean and the
covariance are estimated from sums over all labelled rows that are not held out (no sample, one
aggregation). Covariances shrink towards the pooled one and its diagonal. The score is the logistic of
the difference of the classes' log densities plus log prior odds, with Mahalanobis distances from
inverted Cholesky factors that are computed once.

Defined results: a null text is like an empty one; a null label is no label, and of several labels of
an id the smallest counts; without labels of one class all scores are 0.5; repeated rows get equal
scores, and a labelled id counts once for each of its rows; an empty table gives an empty table; texts are read whole
however long; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.llm.common import col, documents, fresh, materialize
from reportmill.llm.toxicity import held_out

STATISTICS = (
    "log_words", "word_length", "symbols", "capitals", "digits", "stops", "shouts", "white", "accents",
    "vocabulary", "pairs", "dup_lines", "line_words", "top_word",
)

_CLASS = np.zeros(256, int)
for _i, _chars in enumerate((b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b".,;:", b"!?", b" \t\n\r\x0b\x0c", bytes(range(128, 256))), 1):
    _CLASS[list(_chars)] = _i


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a whole text."""
    text = text or ""
    words = text.split()
    n = len(words)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    by = np.bincount(_CLASS[raw], minlength=8) if len(raw) else np.zeros(8, int)
    rate = lambda k: float(np.log((by[k] + 0.5) / (n + 1)))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:]))) if n > 1 else 0  # noqa: B905
    lines = [x for x in text.split("\n") if x.strip()]
    share = lambda a, b: float(np.log((a + 1) / (b + 1)))
    return [
        float(np.log1p(n)), float(np.log1p(len(text) / (n + 1))), rate(1), rate(2), rate(3), rate(4), rate(5), rate(6), rate(7),
        float(np.log1p(len(counts)) / np.log(n + 2)), share(pairs, max(n - 1, 0)), share(len(set(lines)), len(lines)),
        float(np.log1p(n / (len(lines) + 1))), share(max(counts.values(), default=0), n),
    ]


def with_statistics(docs: DataFrame, *, text: str = "text", name: str = "statistics") -> DataFrame:
    (out,) = fresh(docs, name)
    return docs.withColumn(out, F.pandas_udf(lambda s: s.map(statistics), "array<double>")(col(text)))


def fit(stats: DataFrame, labels: DataFrame, *, key: str = "doc_id", label: str = "quality", x: str = "statistics", shrink: float = 0.1, ridge: float = 0.02) -> dict | None:
    """Sums over all labelled rows that are not held out, then the two discriminants."""
    p = len(STATISTICS)
    usable = labels.where(col(label).isin(0, 1) & ~held_out(col(key))).groupBy(col(key).alias("k")).agg(F.min(col(label)).alias("y"))
    rows = stats.select(col(key).alias("k"), col(x).alias("x")).join(usable, "k").select("y", *[F.get("x", F.lit(i)).alias(f"x{i}") for i in range(p)])
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    sums = rows.groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(f"x{i}").alias(f"s{i}") for i in range(p)],
        *[F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}_{j}") for i, j in upper],
    ).collect()  # two rows
    found = {r["y"]: r for r in sums}
    if set(found) != {0, 1}:
        return None
    n, mean, cov = {}, {}, {}
    for y, r in found.items():
        n[y] = r["n"]
        mean[y] = np.array([r[f"s{i}"] for i in range(p)]) / n[y]
        q = np.zeros((p, p))
        for i, j in upper:
            q[i, j] = q[j, i] = r[f"q{i}_{j}"]
        cov[y] = q / n[y] - np.outer(mean[y], mean[y])
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])
    diagonal = np.diag(np.maximum(np.diag(pooled), 1e-6))
    model = {"prior": float(np.log(n[1] / n[0]))}
    for y in (0, 1):
        s = (1 - shrink - ridge) * cov[y] + shrink * pooled + ridge * diagonal
        lower = np.linalg.cholesky(s + 1e-9 * np.eye(p))
        model[y] = (mean[y], np.linalg.inv(lower).T.copy(), float(np.log(np.diag(lower)).sum()))
    return model


def score_rows(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    log = {y: -0.5 * (((x - model[y][0]) @ model[y][1]) ** 2).sum(axis=1) - model[y][2] for y in (0, 1)}
    return 1 / (1 + np.exp(-np.clip(log[1] - log[0] + model["prior"], -500, 500)))


def score(stats: DataFrame, model: dict | None, *, x: str = "statistics", name: str = "score") -> DataFrame:
    (out,) = fresh(stats, name)

    def scores(s: pd.Series) -> pd.Series:
        return pd.Series(score_rows(model, np.stack(s.to_list())) if len(s) else [], dtype="float64")

    return stats.withColumn(out, F.pandas_udf(scores, "double")(col(x)))


def classify(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """(key, statistics, score) of every document; statistics are kept in the shared folder, as they are read twice."""
    stats = materialize(with_statistics(docs.select(key, text), text=text).drop(text), "qda")
    return score(stats, fit(stats, labels, key=key, label=label))


def op10_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored.select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )
