"""Shared pieces of the training-data operators.

Names: every internal column is made with :func:`fresh`, so extra input columns never clash.
Scratch: :func:`materialize` writes a table into the folder that all executors share
(``spark.checkpoint.dir``) and reads it back, which cuts lineage and survives lost executors.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.plans.shipping import ship

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WHITE = " \t\n\u000b\f\r"

#: Bytes in an Arrow batch: texts may be long, and a batch is held whole by a Python worker and its JVM.
BATCH_BYTES = 2 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors and bounds Arrow batches by their bytes, where the session sets no bound.

    The setting stays, as frames run after the call that makes them; no result depends on it.
    """
    if not 0 < int(spark.conf.get(_BATCH_SETTING, None) or 0) <= BATCH_BYTES:
        spark.conf.set(_BATCH_SETTING, BATCH_BYTES)
    return ship(spark)


_written: list[tuple[SparkSession, str]] = []


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like those asked for that the frame does not have yet."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """A column by its exact name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only where Spark itself is local and none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="reportmill-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes the frame as Parquet into the shared folder and reads it again."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/reportmill/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Deletes what :func:`materialize` wrote for this frame; nothing may read it any more."""
    for spark, path in list(_written):
        if any(path in f for f in df.inputFiles()):
            delete(spark, path)
            _written.remove((spark, path))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what :func:`materialize` writes inside; frames made inside must be used up by then."""
    before = set(p for _, p in _written)
    try:
        yield
    finally:
        for entry in [e for e in _written if e[1] not in before]:
            delete(*entry)
            _written.remove(entry)


_of_stages: list[tuple[SparkSession, str]] = []


def begin_stage(docs: DataFrame) -> None:
    """Deletes what earlier stages of a pipeline wrote to the scratch folder, unless ``docs`` reads it.

    For chains in which each stage's result is written before the next stage is called.
    """
    read = docs.inputFiles() if _of_stages else []
    for entry in list(_of_stages):
        if not any(entry[1] in f for f in read):
            _of_stages.remove(entry)
            if entry in _written:
                delete(*entry)
                _written.remove(entry)


@contextmanager
def stage_scratch() -> Iterator[None]:
    """What :func:`materialize` writes inside belongs to a stage; :func:`begin_stage` may delete it."""
    before = list(_written)
    try:
        yield
    finally:
        _of_stages.extend(e for e in _written if e not in before)


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of the shared storage."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the JVM has gone before us
            return


def let(value: Column, body) -> Column:
    """Binds a value once, so that a lambda body can use it many times without computing it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def n_words(text: Column) -> Column:
    """Words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def count_chars(text: Column, chars: str) -> Column:
    """How many code points of a text are among the given ones."""
    return F.coalesce(F.length(text) - F.length(F.translate(text, chars, "")), F.lit(0)).cast("long")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
