import os

from pyspark.sql import functions as F

from reportmill.functions import vocabulary as V
from reportmill.operators import labelling as L
from reportmill.streaming import incremental

SCHEMA = "study long, report string, " + ", ".join(f"`{t}` double" for t in V.TARGETS)


def test_label_reports(spark, tmp_path):
    texts = ["Findings: ACL tear.", "Findings: small joint effusion.", None]
    rows = spark.createDataFrame([(i, t) + (None,) * 12 for i, t in enumerate(texts)], SCHEMA)
    rows.write.parquet(str(tmp_path / "in"))
    run = lambda: incremental.label_reports(spark, str(tmp_path / "in"), SCHEMA, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    run()
    run()  # nothing new
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.count() == 36
    want = L.supervision(rows).select("study", "target", "status")
    assert got.select("study", "target", "status").exceptAll(want).count() == 0


def test_windowed_counts(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    if not os.path.exists(path):
        return
    events = spark.read.parquet(path)
    events.write.parquet(str(tmp_path / "events"))
    stream = incremental.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "events")))
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = events.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").getField("start").alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert spark.table("windows").exceptAll(want).count() == 0 and spark.table("windows").count() == want.count()
