"""Sinks: Parquet and CSV artifacts, Markdown tables, run metadata."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """CSV with a header; nested columns become JSON text. single: one file, for small artifacts."""
    from pyspark.sql import functions as F

    flat = df.select(*[F.to_json(f"`{f.name}`").alias(f.name) if f.dataType.typeName() in ("array", "map", "struct") else F.col(f"`{f.name}`") for f in df.schema.fields])
    (flat.coalesce(1) if single else flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_frames(frames: dict[str, DataFrame], path: str) -> None:
    for name, df in frames.items():
        write_table(df, f"{path}/{name}")


def shown(value: Any) -> str:
    if value is None:
        return "—"
    if isinstance(value, float):
        return f"{value:.4g}"
    return f"{value:,}" if isinstance(value, int) and not isinstance(value, bool) else str(value).replace("|", "\\|").replace("\n", " ")


def markdown(df: DataFrame, rows: int = 100) -> str:
    """A Markdown table of a small frame (the number of rows is the feature)."""
    head = "| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n"
    return head + "".join("| " + " | ".join(map(shown, r)) + " |\n" for r in df.limit(rows).collect())


def metadata(df: DataFrame, **more) -> str:
    """JSON with the schema, the number of rows and the Spark version."""
    return json.dumps({"rows": df.count(), "schema": json.loads(df.schema.json()), "spark": df.sparkSession.version} | more, sort_keys=True)


def human_bytes(n: float) -> str:
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if abs(n) < 1024 or unit == "TiB":
            return f"{n:.1f} {unit}" if unit != "B" else f"{n:.0f} B"
        n /= 1024
    return ""
