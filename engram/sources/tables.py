"""Parquet tables and their mapping to the engine's canonical frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event types of the log, by the type that the driver's stream table has.
EVENT_TYPES = {"purchase": "MEMORY_SAVED", "click": "MEMORY_UPDATED", "error": "MEMORY_DELETED", "view": "MEMORY_RECALLED", "signup": "SESSION_STARTED"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(col: str | Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone."""
    c = F.col(col) if isinstance(col, str) else col
    return F.timestamp_diff("MILLISECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), c)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ms, session_id, event_type, key, value, props: the log with its hot JSON field as a column."""
    e = table(spark, sf_dir, "events")
    kind = F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in EVENT_TYPES.items()))
    return e.select("event_id", millis("ts").alias("ms"), F.col("user_id").alias("session_id"), kind.alias("event_type"), F.get_json_object("props", "$.k").cast("bigint").alias("key"), "value", "props")
