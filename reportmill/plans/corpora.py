"""The two corpora that the registered queries run on.

``docs`` is the documents table as it is. ``reports`` gives every document one of the reports of
:mod:`reportmill.plans.gold` by its id, and official labels to every twentieth, so that detection has
something to find at any scale. SQL fragments for the same tables stand there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.functions import vocabulary as V
from reportmill.plans.gold import TEMPLATES
from reportmill.sources.tables import table

def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("study"), F.col("text").alias("report"), "lang", "source", "n_chars")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(study, report, 12 nullable labels): all or none of the labels are there."""
    texts = F.array(*[F.lit(t) for t, _ in TEMPLATES])
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("study"), F.get(texts, F.pmod("doc_id", F.lit(len(TEMPLATES))).cast("int")).alias("report"))
    labels = [F.when(F.col("study") % 20 == 0, ((F.col("study") / 20).cast("long") + i) % 2).cast("double").alias(t) for i, t in enumerate(V.TARGETS)]
    return rows.select("study", "report", *labels)


#: Normal form of documents in SQL (their letters need no fold beyond these).
NORM_SQL = (
    r"regexp_replace(regexp_replace(regexp_replace(strip_accents(lower(replace(replace(translate(text, 'ıİđĐø', 'iiddo'), 'ß', 'ss'), 'æ', 'ae'))), "
    r"'[_/\\]+|[-‐‑‒–—―]+', ' ', 'g'), '[ \t]+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
)
TOKENS_SQL = rf"regexp_extract_all({NORM_SQL}, '[\p{{L}}\p{{N}}_]+')"
