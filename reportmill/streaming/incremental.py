"""Structured Streaming: reports labelled as they arrive, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from reportmill.operators import labelling as L


def label_reports(spark: SparkSession, source: str, schema: str, sink: str, checkpoint: str, policy: str = "v3") -> StreamingQuery:
    """Labels every new file of a folder of reports once and appends the supervision rows, one folder per batch.

    A batch is labelled whole: a study comes with one report, so nothing is kept between batches. A
    batch that is run again after a failure replaces its own folder.
    """

    def one(batch: DataFrame, number: int) -> None:
        L.supervision(batch, policy).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, at: str = "ts", by: str = "event_type", width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Counts by window and kind; rows later than the watermark no longer count."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, width), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), by, "n")
