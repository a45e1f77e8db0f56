"""Event log: scans, recency, sessions, statistics, retention, checkpoints.

Frames have event_id, ms (epoch milliseconds), session_id, event_type; event ids grow with time within a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def clamp(n: int, low: int, high: int) -> int:
    return max(low, min(n, high))


def by_id(log: DataFrame, event_id: int | str) -> DataFrame:
    return log.filter(F.col("event_id") == event_id)


def by_session(log: DataFrame, session_id: int | str) -> DataFrame:
    return log.filter(F.col("session_id") == session_id).orderBy("ms", "event_id")


def in_range(log: DataFrame, start: Column, end: Column) -> DataFrame:
    """Both ends belong to the range."""
    return log.filter(F.col("ms").between(start, end))


def recent(log: DataFrame, limit: int = 20) -> DataFrame:
    return log.orderBy(F.desc("ms"), F.desc("event_id")).limit(clamp(limit, 1, 1000))


def sessions_with(log: DataFrame, predicate: Column) -> DataFrame:
    """Distinct sessions whose start event meets the predicate (a project folder in its metadata, for one)."""
    return log.filter((F.col("event_type") == "SESSION_STARTED") & predicate).select("session_id").distinct()


def optional_filters(df: DataFrame, **values) -> DataFrame:
    """Equality on each column whose value isn't None."""
    for name, v in values.items():
        if v is not None:
            df = df.filter(F.col(name) == v)
    return df


def stats(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("event_count"), F.count_distinct("session_id").alias("session_count"))


def sessions_by_first_seen(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id").agg(F.min("ms").alias("first_ms")).orderBy("first_ms", "session_id")


def page(log: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page, newest first, with the total number of rows beside each of its rows."""
    total = log.agg(F.count("*").alias("total"))
    rows = log.orderBy(F.desc("ms"), F.desc("event_id")).offset(offset).limit(limit)
    return rows.crossJoin(F.broadcast(total))  # one row


def tail(log: DataFrame, types: list[str], limit: int) -> DataFrame:
    """The last events of some types, oldest first."""
    last = log.filter(F.col("event_type").isin(types)).orderBy(F.desc("ms"), F.desc("event_id")).limit(limit)
    return last.orderBy("ms", "event_id")


def retained(log: DataFrame, now_ms: int, days: int, noisy: str = "OBSERVATION_CAPTURED") -> DataFrame:
    """What retention keeps: ``days`` of events, a quarter of that (a day at least) of the noisy type."""
    cut, noisy_cut = now_ms - days * DAY_MS, now_ms - max(1, days // 4) * DAY_MS
    return log.filter(F.col("ms") >= F.when(F.col("event_type") == noisy, noisy_cut).otherwise(cut))


def checkpoints(log: DataFrame) -> DataFrame:
    """A checkpoint for each session: its last event and how many events stand behind it."""
    return log.groupBy("session_id").agg(F.max("event_id").alias("last_event_id"), F.count("*").alias("event_count"))


def checkpoint_items(live: DataFrame, checkpoint: DataFrame) -> DataFrame:
    """(session_id, last_event_id, key): the bridge rows of checkpoints and the keys that live then."""
    return checkpoint.join(live.select("session_id", "key").distinct(), "session_id").select("session_id", "last_event_id", "key")


def delete_sessions(log: DataFrame, gone: DataFrame) -> DataFrame:
    return log.join(gone.select("session_id").distinct(), "session_id", "left_anti")


def sessions(log: DataFrame, now_ms: int | None = None, ttl_ms: int = 3_600_000) -> DataFrame:
    """Sessions folded from events: those with a start and no end.

    status: paused if the last pause or resume is a pause, else active; with ``now_ms``, expired after ``ttl_ms`` idle.
    """
    kind = F.col("event_type")
    state = F.when(kind.isin("SESSION_PAUSED", "SESSION_RESUMED"), F.struct("event_id", "event_type"))
    s = log.groupBy("session_id").agg(
        F.min(F.when(kind == "SESSION_STARTED", F.col("ms"))).alias("started_ms"),
        F.max("ms").alias("last_ms"),
        F.count("*").alias("event_count"),
        F.count_if(kind == "MEMORY_SAVED").alias("saves"),
        F.count_if(kind == "SESSION_ENDED").alias("ends"),
        F.max(state).alias("state"),
    )
    status = F.when(F.col("state.event_type") == "SESSION_PAUSED", "paused").otherwise("active")
    if now_ms is not None:
        status = F.when(F.col("last_ms") < now_ms - ttl_ms, "expired").otherwise(status)
    return s.filter("started_ms is not null and ends = 0").select("session_id", "started_ms", "last_ms", "event_count", "saves", status.alias("status"))


def idle_sessions(log: DataFrame, gap_ms: int) -> DataFrame:
    """Runs of a user's events that no gap of ``gap_ms`` parts: (session_id, run, start_ms, end_ms, n)."""
    w = Window.partitionBy("session_id").orderBy("ms", "event_id")
    new = F.coalesce(F.col("ms") - F.lag("ms").over(w) >= gap_ms, F.lit(True))
    runs = log.withColumn("run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("session_id", "run").agg(F.min("ms").alias("start_ms"), F.max("ms").alias("end_ms"), F.count("*").alias("n"))


def causality_chain(log: DataFrame, depth: int = 10) -> DataFrame:
    """(event_id, ancestor, hops) along ``caused_by``; a link is followed ``depth`` times at most."""
    edge = log.select("event_id", "caused_by").filter("caused_by is not null")
    level = edge.select("event_id", F.col("caused_by").alias("ancestor"), F.lit(1).alias("hops"))
    out = level
    for _ in range(depth - 1):
        step = edge.select(F.col("event_id").alias("ancestor"), F.col("caused_by").alias("up"))
        level = level.join(step, "ancestor").select("event_id", F.col("up").alias("ancestor"), (F.col("hops") + 1).alias("hops"))
        out = out.unionByName(level)
    return out
