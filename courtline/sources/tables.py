"""Writing published tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_seasons(rows: DataFrame, path: str, by: Sequence[str] = ("pool", "season")) -> None:
    """Replaces the partitions that rows have, and keeps others."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(*by).parquet(path)


def write_summary(rows: DataFrame, path: str, kind: str) -> None:
    """A small table as CSV with a header, or as JSON lines."""
    (rows.write.mode("overwrite").option("header", True).csv if kind == "csv" else rows.write.mode("overwrite").json)(path)
