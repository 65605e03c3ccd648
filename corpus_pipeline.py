"""A corpus pipeline of five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's documents. All but the last return the columns of documents.

1. ``quality_rules`` keeps the documents that weakly supervised rules judge good.
2. ``line_dedup`` takes duplicate lines out; documents that only consisted of such lines go. Near copies of one
   earlier document, by the criterion of the next stage, stay whole for that stage.
3. ``simhash`` keeps one document of each group of near duplicates: five-word shingles, similarity 0.8 or more.
4. ``mixing`` samples the sources to their target weights; a document may come several times.
5. ``bpe`` encodes and decodes every text.

Defined results: null and empty texts fail the quality rules, so no later stage sees one unless called
alone; an empty table passes through as an empty table; other columns are kept, and ``n_chars`` is set
to the length of a changed text.
"""

from __future__ import annotations

import uuid
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.llm import bpe, line_dedup, mixing, quality_rules, simhash
from reportmill.llm.common import WORD, begin_stage, delete, fresh, prepare, scratch, scratch_dir, stage_scratch


#: Near duplicates: at least this Jaccard coefficient of the sets of shingles of so many words.
NEAR_WORDS, NEAR = 5, 0.8
#: A document is looked at as a copy when a single earlier one holds more than this share of its characters.
COPY_SHARE = 0.5


def _stage(function):
    """A stage: by contract the result of the one before has been written, so that one's scratch goes first."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        prepare(spark)
        begin_stage(docs)
        with stage_scratch():
            return function(spark, docs, sf_dir)

    return run_stage


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


@_stage
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    (taken,) = fresh(docs, "lines_taken")
    clean = line_dedup.dedup(docs, dropped=taken, copy_share=COPY_SHARE, similarity=NEAR, words=NEAR_WORDS)
    clean = clean.where((F.col(taken) == 0) | F.col("text").rlike(WORD))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.when(F.col(taken) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


@_stage
def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs, shingle=NEAR_WORDS, similarity=NEAR)


@_stage
def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


@_stage
def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.digests(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash", simhash_stage),
    ("mixing", mixing_stage),
    ("bpe", bpe_stage),
]

#: Edit joins, SimHash and BPE are not expressible in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir. A stage's scratch and the output before it are deleted once it is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    base = f"{scratch_dir(spark)}/reportmill/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        if before is not None:
            delete(spark, before)
        docs, before = spark.read.parquet(f"{base}/{name}"), f"{base}/{name}"
    return docs
