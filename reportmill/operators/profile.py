"""Corpus analytics: lengths, duplicates, template families, vocabulary, similarity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportmill.functions import text as X
from reportmill.operators import relational as R


def lengths(texts: DataFrame, by: list[str], text: str) -> DataFrame:
    """Characters and words of every text, described by group: one row per group and measure."""
    words = F.size(X.tokens(F.col(text)))
    measures = F.explode(F.array(F.struct(F.lit("characters").alias("measure"), F.length(text).cast("double").alias("value")), F.struct(F.lit("words").alias("measure"), words.cast("double").alias("value"))))
    return R.describe(texts.select(*by, measures.alias("m")).select(*by, "m.*"), [*by, "measure"], "value")


def families(texts: DataFrame, text: str) -> DataFrame:
    """Adds hashes of the normalized text as it is and with masked numbers."""
    norm = X.normalize(F.col(text))
    return texts.withColumn("exact_family", X.sha256(F.concat(F.lit("exact:"), norm))).withColumn("numeric_family", X.sha256(F.concat(F.lit("numeric:"), X.mask_numbers(norm))))


def duplicate_groups(texts: DataFrame, key: str, by: str) -> DataFrame:
    """(by, n, first_key) of values that occur twice or more; repeats are summed before they are dealt."""
    return texts.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key")).where("n > 1")


def duplicate_summary(texts: DataFrame, by: str) -> DataFrame:
    """Totals: rows, distinct values, excess rows, groups of two and more, the largest."""
    sizes = texts.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.sum(F.col("n") - 1).alias("excess"), F.count_if(F.col("n") > 1).alias("n_groups"), F.max("n").alias("largest")
    )


def inconsistent_families(labelled: DataFrame, family: str, target: str, value: str) -> DataFrame:
    """(family, target, n, n_values) of families of two and more; a consistent one has one value a target."""
    return labelled.groupBy(family, target).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce(F.col(value).cast("string"), F.lit("null"))).alias("n_values")).where("n > 1")


def gram_counts(texts: DataFrame, text: str, n: int, by: list[str] | None = None) -> DataFrame:
    """(by, gram, n) over all texts."""
    grams = X.ngrams(X.tokens(X.normalize(F.col(text))), n)
    return texts.select(*(by or []), F.explode(grams).alias("gram")).groupBy(*(by or []), "gram").agg(F.count(F.lit(1)).alias("n"))


def diversity(counts: DataFrame, heads: tuple[int, ...] = (10, 25, 50, 100)) -> DataFrame:
    """Types, tokens, their ratio and the share of the most frequent grams (ties by gram)."""
    top = counts.orderBy(F.desc("n"), "gram").limit(max(heads)).withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "gram")))
    head = top.agg(*[F.coalesce(F.sum(F.when(F.col("r") <= k, F.col("n"))), F.lit(0)).alias(f"n_top{k}") for k in heads])
    total = counts.agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"))
    both = total.join(F.broadcast(head))
    return both.select("types", "tokens", (F.col("types") / F.col("tokens")).alias("type_token_ratio"), *[(F.col(f"n_top{k}") / F.col("tokens")).alias(f"top{k}_share") for k in heads])


def document_frequency(texts: DataFrame, text: str, by: list[str], least: int = 4, without: tuple[str, ...] = ()) -> DataFrame:
    """In how many texts each word of a least length occurs."""
    words = F.array_distinct(F.filter(X.tokens(X.normalize(F.col(text))), lambda w: (F.length(w) >= least) & ~w.isin("", *without)))
    return texts.select(*by, F.explode(words).alias("word")).groupBy(*by, "word").agg(F.count(F.lit(1)).alias("n_docs"))


def sampled_pairs(texts: DataFrame, key: str, text: str, seed: int, n: int) -> DataFrame:
    """Token-set similarity of all pairs among the n texts that come first by hash (n is the feature)."""
    few = R.hash_sample(texts.select(key, text), key, seed, n).select(key, F.array_distinct(X.tokens(X.normalize(F.col(text)))).alias("w"))
    a, b = few.select(F.col(key).alias("a"), F.col("w").alias("wa")), few.select(F.col(key).alias("b"), F.col("w").alias("wb"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", X.jaccard(F.col("wa"), F.col("wb")).alias("similarity"))
