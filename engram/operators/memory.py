"""Memories as folds over the event log: hydration, live sets, supersedes, conflicts, recall filters, visibility."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LATEST = lambda *keys: Window.partitionBy(*keys).orderBy(F.desc("event_id"))


def latest_per(df: DataFrame, *keys: str, order: tuple[str, ...] = ("event_id",)) -> DataFrame:
    """The last row of each key by ``order``. Grouping by the largest struct aggregates before the shuffle, so a key
    with a third of all rows costs no more than others."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    return df.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("r")).select(*keys, *(f"r.{c}" for c in (*order, *rest)))


def live(log: DataFrame) -> DataFrame:
    """Keys whose last save has no later delete: (key, event_id of the save, session_id, ms, value)."""
    save = F.when(F.col("event_type") == "MEMORY_SAVED", F.struct("event_id", "session_id", "ms", "value"))
    gone = F.max(F.when(F.col("event_type") == "MEMORY_DELETED", F.col("event_id")))
    g = log.groupBy("key").agg(F.max(save).alias("s"), gone.alias("gone"))
    return g.filter("s is not null and (gone is null or gone < s.event_id)").select("key", "s.*")


def hydrate(log: DataFrame) -> DataFrame:
    """Replay by (session, key): the last save since the last delete, then the updates after it.

    An update sets the value; the memory keeps the save's creation time and takes the last change's time. (session_id,
    key, memory_id, created_ms, updated_ms, value, updates).
    """
    kind = F.col("event_type")
    keys = ("session_id", "key")
    ends = log.groupBy(*keys).agg(
        F.max(F.when(kind == "MEMORY_SAVED", F.struct("event_id", "ms", "value"))).alias("save"),
        F.max(F.when(kind == "MEMORY_DELETED", F.col("event_id"))).alias("gone"),
    )
    ends = ends.filter("save is not null and (gone is null or gone < save.event_id)").drop("gone")
    changes = log.filter(kind == "MEMORY_UPDATED").select(*keys, F.struct("event_id", "ms", "value").alias("u"))
    later = F.when(F.col("u.event_id") > F.col("save.event_id"), F.col("u"))
    folded = ends.join(changes, list(keys), "left").groupBy(*keys, "save").agg(F.max(later).alias("last"), F.count(later).alias("updates"))
    return folded.select(*keys, F.col("save.event_id").alias("memory_id"), F.col("save.ms").alias("created_ms"), F.coalesce("last.ms", "save.ms").alias("updated_ms"), F.coalesce("last.value", "save.value").alias("value"), "updates")


def supersedes(log: DataFrame) -> DataFrame:
    """(key, event_id, superseded_by): all saves of a key but the newest, each pointing to the newest."""
    saves = log.filter(F.col("event_type") == "MEMORY_SAVED").select("key", "event_id")
    newest = saves.groupBy("key").agg(F.max("event_id").alias("superseded_by"))
    return saves.join(newest, "key").filter("event_id < superseded_by")


def duplicate_keys(log: DataFrame) -> DataFrame:
    saves = log.filter(F.col("event_type") == "MEMORY_SAVED")
    return saves.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")


def cross_session(log: DataFrame, session_id: int, limit: int = 500) -> DataFrame:
    """The newest saves of other sessions that aren't deleted or superseded later."""
    saves = log.filter((F.col("event_type") == "MEMORY_SAVED") & (F.col("session_id") != session_id))
    ends = log.filter(F.col("event_type").isin("MEMORY_DELETED", "MEMORY_SUPERSEDED")).groupBy("key").agg(F.max("event_id").alias("ended"))
    rows = saves.join(ends, "key", "left").filter("ended is null or ended < event_id").drop("ended")
    return rows.orderBy(F.desc("ms"), F.desc("event_id")).limit(limit)


def unresolved(conflicts: DataFrame, resolved: DataFrame, on: str = "key") -> DataFrame:
    return conflicts.join(resolved.select(on).distinct(), on, "left_anti")


def glob_pattern(pattern: str) -> str:
    """``*`` and ``?`` of a key pattern as an anchored regular expression."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "$"


def like_contains(col: Column, text: str) -> Column:
    """Case-insensitive containment with the pattern's own marks taken literally."""
    marked = re.sub(r"([\\%_])", r"\\\1", text)
    return col.ilike(f"%{marked}%")


def recall(memories: DataFrame, *, key: str | None = None, pattern: str | None = None, sort: str = "created_ms", ascending: bool = False, limit: int = 100, offset: int = 0, **equal) -> DataFrame:
    """Exact key, else key pattern; then equality filters; then a page in a total order."""
    if key is not None:
        memories = memories.filter(F.col("key") == key)
    elif pattern is not None:
        memories = memories.filter(F.col("key").rlike(glob_pattern(pattern)))
    for name, v in equal.items():
        if v is not None:
            memories = memories.filter(F.col(name) == v)
    order = F.asc(sort) if ascending else F.desc(sort)
    return memories.orderBy(order, "key").offset(offset).limit(limit)


def visible(owner: Column, scope: Column, owner_role: Column, agent: Column, role: Column) -> Column:
    """Whether an agent sees a memory: public or unscoped ones always; else its own, shared ones, those of its role."""
    none = F.coalesce(agent, F.lit("")) == ""
    same_role = (F.coalesce(role, F.lit("")) != "") & (role == owner_role)
    return (
        F.when(scope.isNull() | (scope == "public"), True)
        .when(none, False)
        .when(owner == agent, True)
        .when(scope == "shared", True)
        .when(scope == "role", F.coalesce(same_role, F.lit(False)))
        .otherwise(False)
    )


def dimension_counts(memories: DataFrame, *dimensions: str) -> DataFrame:
    """(dimension, value, n) for each dimension and the total, in one pass of grouping sets; null values are left out."""
    sets = [F.col(d) for d in dimensions]
    cubed = memories.groupingSets([[c] for c in sets] + [[]], *sets).agg(F.count("*").alias("n"), F.grouping_id(*sets).alias("g"))
    k, out = len(dimensions), None
    name, value = F.lit("total"), F.lit("")
    for i, d in enumerate(dimensions):
        only = ((1 << k) - 1) & ~(1 << (k - 1 - i))
        name = F.when(F.col("g") == only, d).otherwise(name)
        value = F.when(F.col("g") == only, F.col(d).cast("string")).otherwise(value)
    out = cubed.select(name.alias("dimension"), value.alias("value"), "n")
    return out.filter("value is not null")


def merge_first(*ranked: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """Ordered union: of rows with the same key that of the earliest list stays."""
    rows = None
    for i, df in enumerate(ranked):
        part = df.select(key, *keep, F.lit(i).alias("source_rank"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy(key).agg(F.min(F.struct("source_rank", *keep)).alias("r")).select(key, "r.*")


def merge_max(*scored: DataFrame, key: str, score: str = "score") -> DataFrame:
    """Union that keeps the highest score of each key."""
    rows = scored[0]
    for df in scored[1:]:
        rows = rows.unionByName(df)
    return rows.groupBy(key).agg(F.max(score).alias(score))
