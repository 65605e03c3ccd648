from reportmill.functions import vocabulary as V
from reportmill.plans import runs
from reportmill.plans.gold import TEMPLATES


def test_all_runs(spark, tmp_path):
    rows = [(i, TEMPLATES[i % len(TEMPLATES)][0], *([float(i % 2)] * 12 if i % 20 == 0 else [None] * 12)) for i in range(60)]
    df = spark.createDataFrame(rows, "study long, report string, " + ", ".join(f"`{t}` double" for t in V.TARGETS))
    df.write.parquet(str(tmp_path / "reports"))
    runs.main(["label", "--reports", str(tmp_path / "reports"), "--out", str(tmp_path / "labels")])
    assert spark.read.parquet(str(tmp_path / "labels/supervision")).count() == 720
    names = runs.inspect(spark, df, str(tmp_path / "frames"))
    assert len(names) >= 24 and all(spark.read.parquet(str(tmp_path / "frames" / n)).columns for n in names)
    counts = runs.prepare(spark, df, str(tmp_path / "sets")).collect()
    assert sum(r["n"] for r in counts) > 20
    assert spark.read.parquet(str(tmp_path / "sets/train")).count() > 0
