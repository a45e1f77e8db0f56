"""Mutable state as snapshots: upserts, ignores, replaces, quotas, locks, mining queues, throttles."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """The snapshot after ``new`` rows, one a key: columns in ``keep`` stay those of the old row where there is one."""
    names = [c for c in old.columns if c != key]
    j = old.select(key, *(F.col(c).alias(f"_o_{c}") for c in names), F.lit(True).alias("_old")).join(new.select(key, *(F.col(c).alias(f"_n_{c}") for c in names), F.lit(True).alias("_new")), key, "full_outer")
    stays = F.col("_new").isNull()
    pick = lambda c: F.when(stays | (F.col("_old").isNotNull() if c in keep else F.lit(False)), F.col(f"_o_{c}")).otherwise(F.col(f"_n_{c}")).alias(c)
    return j.select(key, *map(pick, names))


def replace(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows that enter: new keys only."""
    return new.join(old.select(key).distinct(), key, "left_anti")


def usage_percent(bytes_used, bytes_limit, count, count_limit):
    share = F.greatest(bytes_used / bytes_limit * 100, count / count_limit * 100)
    return F.round(F.least(F.lit(100.0), share), 2)


def admit_step(max_bytes: int, max_count: int):
    """Admitted unless the agent would pass a limit; a refused request takes nothing. A null size counts as 0."""

    def step(state, row):
        used, count = state or (0, 0)
        ok = used + (row["size"] or 0) <= max_bytes and count < max_count
        return ((used + (row["size"] or 0), count + 1) if ok else (used, count)), ok

    return step


def admit(requests: DataFrame, max_bytes: int, max_count: int) -> DataFrame:
    """(agent, seq, size, admitted): sequential admission by agent, in order of seq."""
    rows = requests.select("agent", "seq", "size")
    return sequential(rows, "agent", "seq", admit_step(max_bytes, max_count)).withColumnRenamed("accepted", "admitted")


def sequential(rows: DataFrame, key: str, order: str | list[str], fn, schema: str | None = None) -> DataFrame:
    """Rows of each key in order through a step: fn(state, row dict) -> (state, output); adds ``accepted``.

    Keys are ordered by a secondary sort and stream through one after another in Arrow batches; the state is a few numbers,
    so a key of any size needs no memory for its group, but its rows pass one task in order, as the step asks. Null keys are
    one key; an empty table gives an empty one; a column named accepted is replaced.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.drop("accepted")
    ordered = rows.repartition(n, key).sortWithinPartitions(key, *([order] if isinstance(order, str) else order))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = object(), None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if row[key] != current:
                    current, state = row[key], None
                state, y = fn(state, row)
                out.append(y)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.bool_())], names=[*b.schema.names, "accepted"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return ordered.mapInArrow(run, schema or f"{kinds}, accepted boolean")


def dedup_step(window_ms: int):
    """Accept unless the last accepted one is less than ``window_ms`` before."""

    def step(last, row):
        return (last, False) if last is not None and row["ms"] - last < window_ms else (row["ms"], True)

    return step


def sliding_step(window_ms: int):
    """Fire unless the last occurrence, fired or not, is less than ``window_ms`` before."""

    def step(last, row):
        return row["ms"], last is None or row["ms"] - last >= window_ms

    return step


def rate_step(limit: int, window_ms: int):
    """A fixed window that opens with the first request after the last one ended."""

    def step(state, row):
        start, n = state or (None, 0)
        if start is None or row["ms"] >= start + window_ms:
            start, n = row["ms"], 0
        return (start, n + 1), n < limit

    return step


def lock_step(ttl_ms: int):
    """Granted if free, expired or held by the same holder; a grant renews the time to live."""

    def step(state, row):
        holder, until = state or (None, 0)
        if holder is None or row["ms"] >= until or holder == row["holder"]:
            return (row["holder"], row["ms"] + ttl_ms), True
        return state, False

    return step


def drift_step(percent: float):
    """Whether a value drifts more than ``percent`` from the baseline, which moves only when it doesn't."""

    def step(base, row):
        v = row["value"]
        if v is None:
            return base, False
        if base is None or base == 0:
            return v, False
        drifts = abs(v - base) / abs(base) * 100 > percent
        return (base if drifts else v), drifts

    return step


def recover_stale(queue: DataFrame, now_ms: int, after_ms: int = 3_600_000) -> DataFrame:
    """Rows that have been processing for too long are pending again."""
    late = (F.col("status") == "processing") & (F.col("started_ms") < now_ms - after_ms)
    return queue.withColumn("status", F.when(late, "pending").otherwise(F.col("status")))


def oldest_pending(queue: DataFrame, n: int) -> DataFrame:
    return queue.filter("status = 'pending'").orderBy("created_ms", "id").limit(n)
