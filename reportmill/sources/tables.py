"""Sources: typed scans of Parquet and CSV, folders of tables, file trees, casts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV file or folder with a header and a fixed schema; a multi-line quoted field stays one value."""
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def csv_folder(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """Every named CSV of a folder, also registered as a view."""
    out = {}
    for name, schema in schemas.items():
        out[name] = csv(spark, f"{path}/{name}.csv", schema)
        out[name].createOrReplaceTempView(name)
    return out


def file_tree(spark: SparkSession, path: str, pattern: str, glob: str = "*") -> DataFrame:
    """(group, n_files, bytes, first_file): files below a path by a group that a pattern finds in their path. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.groupBy(F.regexp_extract("path", pattern, 1).alias("group")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("length").alias("bytes"), F.min(name).alias("first_file"))


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def number(c: Column) -> Column:
    """A number, or null where the text is none."""
    return c.try_cast("double") if hasattr(c, "try_cast") else F.expr(f"try_cast({c} as double)")


def header_value(values: Column) -> Column:
    """One text of a multi-valued header field, null where blank."""
    return F.nullif(F.trim(F.array_join(values, "\\")), F.lit(""))
