"""Sinks: appends, partitioned exports, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append(df: DataFrame, path: str, *partitions: str) -> None:
    """One write job is one atomic batch."""
    writer = df.write.mode("append")
    (writer.partitionBy(*partitions) if partitions else writer).parquet(path)


def export_relevant(memories: DataFrame, path: str, least: float = 0.7, limit: int = 100) -> None:
    """The highest-scored memories, a folder for each category."""
    memories.filter(F.col("score") >= least).orderBy(F.desc("score"), "memory_id").limit(limit).write.mode("overwrite").partitionBy("category").parquet(path)


def save_manifest(files: DataFrame, path: str) -> None:
    files.select("path", "sha256", "bytes").write.mode("overwrite").json(path)
