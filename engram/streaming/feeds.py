"""Streaming operators: change feed, deduplication, throttles, session windows, alerts, locks.

Each takes a streaming (or batch) DataFrame with an event-time column ``ts``; exact stateful ones keep a few numbers a key
in ``applyInPandasWithState`` and time out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def change_feed(changes: DataFrame, *, channel: str | None = None, category: str | None = None, agent: str | None = None, role: str | None = None) -> DataFrame:
    """Changes that a subscriber may see: private ones never, role ones with the role; values of others' are stripped
    unless they are public."""
    for name, v in (("channel", channel), ("category", category)):
        if v is not None:
            changes = changes.filter(F.col(name) == v)
    scope = F.coalesce("agent_scope", F.lit("public"))
    mine = F.coalesce(F.col("agent_id") == F.lit(agent), F.lit(False)) if agent else F.lit(False)
    same_role = F.coalesce(F.col("agent_role") == F.lit(role), F.lit(False)) if role else F.lit(False)
    seen = mine | scope.isin("public", "shared") | ((scope == "role") & same_role)
    return changes.filter(seen).withColumn("value", F.when(mine | (scope == "public"), F.col("value")))


def dedup(observations: DataFrame, keys: list[str], within: str = "30 seconds") -> DataFrame:
    """First-seen deduplication within the watermark."""
    return observations.withWatermark("ts", within).dropDuplicatesWithinWatermark(keys)


def tumbling_counts(events: DataFrame, width: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n")


def session_counts(events: DataFrame, gap: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user that end after ``gap`` without events."""
    s = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy(s, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def threshold_alerts(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Metrics beyond a rule (name, low, high, severity); rules are a handful of rows."""
    return metrics.join(F.broadcast(rules), "name").filter((F.col("value") >= F.col("low")) & (F.col("value") < F.col("high")))


def accept_spaced(events: DataFrame, key: str, gap_ms: int, sliding: bool = False, late: str = "10 minutes") -> DataFrame:
    """(key, event_id, ms) accepted at least ``gap_ms`` after the last accepted one, or, sliding, the last seen one.

    Exact for rows in order within a micro-batch; state is one number a key and goes when the watermark passes it.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["ms", "event_id"])
        keep = []
        for ms in rows["ms"]:
            ok = last is None or ms - last >= gap_ms
            keep.append(ok)
            if ok or sliding:
                last = int(ms)
        state.update((last,))
        state.setTimeoutTimestamp(max(last + gap_ms, state.getCurrentWatermarkMs() + 1))
        yield rows.loc[keep, [key, "event_id", "ms"]]

    kind = dict(events.dtypes)[key]
    timed = events.withWatermark("ts", late).select(key, "event_id", "ts", F.unix_millis("ts").alias("ms"))
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, event_id bigint, ms bigint", "last bigint", "append", GroupStateTimeout.EventTimeTimeout)
