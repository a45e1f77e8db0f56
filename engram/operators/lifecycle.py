"""Memory writes, session lifecycle, maintenance: event rows from requests, partial updates, reaping, snapshots, cascades.

Log frames are those of ``operators.events``; every operator is a plan of aggregates, joins and windows by session or key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators import events as ev
from engram.operators import memory as mem
from engram.operators import scoring as sc


def hydrate_partial(changes: DataFrame, fields: list[str], metadata: str = "metadata", keys: tuple[str, ...] = ("session_id", "key")) -> DataFrame:
    """Memories with each field's last value that isn't null since the last save, and the metadata maps merged in order.

    ``changes``: event_id, event_type and ``fields``, where a null field of an update leaves it as it is. A key whose last
    save has a later delete is gone. Merging takes the last value of each metadata entry, so a map grows with the distinct
    entries of a memory, not with its changes.
    """
    kind = F.col("event_type")
    ends = changes.groupBy(*keys).agg(
        F.max(F.when(kind == "MEMORY_SAVED", F.col("event_id"))).alias("memory_id"),
        F.max(F.when(kind == "MEMORY_DELETED", F.col("event_id"))).alias("_gone"),
    )
    ends = ends.filter("memory_id is not null and (_gone is null or _gone < memory_id)").drop("_gone")
    since = changes.filter(kind.isin("MEMORY_SAVED", "MEMORY_UPDATED")).join(ends, list(keys)).filter("event_id >= memory_id")
    last = [F.max(F.when(F.col(f).isNotNull(), F.struct("event_id", f))).getField(f).alias(f) for f in fields]
    folded = since.groupBy(*keys, "memory_id").agg(*last, F.max("event_id").alias("last_event_id"))
    entries = since.select(*keys, "event_id", F.explode(metadata).alias("_k", "_v"))
    entries = entries.groupBy(*keys, "_k").agg(F.max_by("_v", "event_id").alias("_v"))
    merged = entries.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("_k", "_v")))).alias(metadata))
    return folded.join(merged, list(keys), "left")


def plan_writes(requests: DataFrame, live: DataFrame, key: str = "key", order: str = "request_id") -> DataFrame:
    """``requests`` (op: save, upsert or delete) with the event that each makes: MEMORY_SAVED, MEMORY_UPDATED or
    MEMORY_DELETED, or ``conflict`` for a save of a live key and null for a delete of a dead one.

    After a save or an upsert a key lives and after a delete it doesn't, whatever was before; so what a request meets is
    told by the one before it.
    """
    before = F.lag("op").over(Window.partitionBy(key).orderBy(order))
    rows = requests.join(live.select(key).distinct().withColumn("_live", F.lit(True)), key, "left").withColumn("_before", before)
    alive = F.when(F.col("_before").isNull(), F.coalesce("_live", F.lit(False))).otherwise(F.col("_before") != "delete")
    event = (
        F.when(F.col("op") == "save", F.when(alive, "conflict").otherwise("MEMORY_SAVED"))
        .when(F.col("op") == "upsert", F.when(alive, "MEMORY_UPDATED").otherwise("MEMORY_SAVED"))
        .when((F.col("op") == "delete") & alive, "MEMORY_DELETED")
    )
    return rows.withColumn("event", event).drop("_live", "_before")


def write_events(log: DataFrame) -> DataFrame:
    """The events that memory changes stand for: every save that isn't a key's last is followed by its supersede.

    (event_id, key, event, other): the change itself, and for superseded saves MEMORY_SUPERSEDED with the newest save.
    """
    own = log.filter(F.col("event_type").isin("MEMORY_SAVED", "MEMORY_UPDATED", "MEMORY_DELETED"))
    own = own.select("event_id", "key", F.col("event_type").alias("event"), F.lit(None).cast("bigint").alias("other"))
    old = mem.supersedes(log).select("event_id", "key", F.lit("MEMORY_SUPERSEDED").alias("event"), F.col("superseded_by").cast("bigint").alias("other"))
    return own.unionByName(old)


# ---- sessions -------------------------------------------------------------------------------------------------------


def reap(sessions: DataFrame, now_ms: int, ttl_ms: int = 3_600_000) -> DataFrame:
    """(session_id, event_type, idle_ms): a SESSION_ENDED for each active session that is idle for longer than the ttl."""
    idle = F.lit(now_ms) - F.col("last_ms")
    late = sessions.filter(F.col("status") != "paused").withColumn("idle_ms", idle).filter(F.col("idle_ms") > ttl_ms)
    return late.select("session_id", F.lit("SESSION_ENDED").alias("event_type"), "idle_ms")


def startable(sessions: DataFrame, limit: int = 50) -> DataFrame:
    """(active, free): how many sessions are active and how many more may start."""
    n = F.count_if(F.col("status") == "active")
    return sessions.agg(n.alias("active"), F.greatest(F.lit(0), F.lit(limit) - n).cast("bigint").alias("free"))


def list_sessions(sessions: DataFrame, status: str | None = None, limit: int = 10) -> DataFrame:
    """The sessions started last, with an optional status."""
    return ev.optional_filters(sessions, status=status).orderBy(F.desc("started_ms"), "session_id").limit(limit)


def loaded_context(log: DataFrame, links: DataFrame) -> DataFrame:
    """(session_id, source, loaded): saves of the source session that a session continues from, 0 without any."""
    saves = log.filter(F.col("event_type") == "MEMORY_SAVED").groupBy("session_id").agg(F.count("*").alias("loaded"))
    return links.join(saves.withColumnRenamed("session_id", "source"), "source", "left").select("session_id", "source", F.coalesce("loaded", F.lit(0)).alias("loaded"))


def auto_checkpoints(log: DataFrame, every_ms: int = 300_000) -> DataFrame:
    """(session_id, due_ms, last_event_id, events): a checkpoint at the end of each interval in which a session had events."""
    due = (F.floor(F.col("ms") / every_ms) + 1) * every_ms
    return log.groupBy("session_id", due.alias("due_ms")).agg(F.max("event_id").alias("last_event_id"), F.count("*").alias("events"))


def checkpoint_record(log: DataFrame, live: DataFrame, description: str = "") -> DataFrame:
    """(session_id, last_event_id, memory_count, description, memory_keys): a session's checkpoint with its live keys, sorted.

    The list of keys is the record that the checkpoint stores; ``events.checkpoint_items`` has the same as rows.
    """
    last = log.groupBy("session_id").agg(F.max("event_id").alias("last_event_id"))
    keys = live.groupBy("session_id").agg(F.sort_array(F.collect_set("key")).alias("memory_keys"))
    out = last.join(keys, "session_id", "left").withColumn("memory_keys", F.coalesce("memory_keys", F.array().cast(keys.schema["memory_keys"].dataType)))
    return out.select("session_id", "last_event_id", F.size("memory_keys").alias("memory_count"), F.lit(description).alias("description"), "memory_keys")


def snapshot(memories: DataFrame, name: str, dimension: str) -> DataFrame:
    """(name, stats): a named checkpoint of counts as JSON: {"total": n, "by": {value: n}}, values sorted, nulls left out."""
    by = memories.filter(F.col(dimension).isNotNull()).groupBy(dimension).agg(F.count("*").alias("n"))
    by = by.agg(F.sort_array(F.collect_list(F.struct(F.col(dimension).cast("string").alias("k"), "n"))).alias("e"))
    stats = F.struct(F.col("total"), F.map_from_entries(F.coalesce("e", F.array().cast("array<struct<k: string, n: bigint>>"))).alias("by"))
    return memories.agg(F.count("*").alias("total")).crossJoin(F.broadcast(by)).select(F.lit(name).alias("name"), F.to_json(stats).alias("stats"))  # one row each


def counts_of(memories: DataFrame, column: str, names: list[str]) -> DataFrame:
    """(value, n) for each of the names, 0 where there is none."""
    counted = memories.agg(*(F.count_if(F.col(column) == v).alias(v) for v in names))
    return counted.select(F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).alias("n")) for v in names))).alias("r")).select("r.*")


# ---- cascades -------------------------------------------------------------------------------------------------------


def delete_cascade(gone: DataFrame, items: DataFrame, checkpoints: DataFrame, log: DataFrame) -> dict[str, DataFrame]:
    """What stays of checkpoint items, checkpoints and events once sessions (session_id) go, and ``orphans``: items left
    whose checkpoint isn't there."""
    ids = gone.select("session_id").distinct()
    left = checkpoints.join(ids, "session_id", "left_anti")
    lost = checkpoints.join(ids, "session_id", "left_semi").select("checkpoint_id")
    kept = items.join(lost, "checkpoint_id", "left_anti")
    orphans = kept.join(left.select("checkpoint_id"), "checkpoint_id", "left_anti")
    return {"items": kept, "checkpoints": left, "events": ev.delete_sessions(log, ids), "orphans": orphans}


def maintenance(log: DataFrame, now_ms: int, days: int = 30) -> DataFrame:
    """(step, n): what a maintenance cycle does to a log: saves to supersede, keys that live on, events that retention drops,
    events of the noisy type that go early."""
    dedup = mem.supersedes(log).agg(F.count("*").alias("n")).withColumn("step", F.lit("dedup"))
    live = mem.live(log).agg(F.count("*").alias("n")).withColumn("step", F.lit("live"))
    kept = ev.retained(log, now_ms, days, noisy="MEMORY_RECALLED")
    cut = F.lit(now_ms - days * ev.DAY_MS)
    pruned = log.agg(F.count_if(F.col("ms") < cut).alias("n")).withColumn("step", F.lit("retention"))
    rest = kept.agg(F.count("*").alias("n")).withColumn("step", F.lit("kept"))
    out = dedup.unionByName(live).unionByName(pruned).unionByName(rest)
    return out.select("step", "n")


# ---- relevance and payloads -----------------------------------------------------------------------------------------


def payload(log: DataFrame, payload_col: str = "payload", metadata_col: str = "metadata") -> DataFrame:
    """(memory_id, key, session_id, value, category, priority) of each memory's newest save: from the payload's memory
    object, priority and category else from the event's metadata. A payload that is no JSON object gives nulls."""
    newest = log.groupBy("memory_id").agg(F.max(F.struct("event_id", payload_col, metadata_col)).alias("r"))
    p, m = F.col(f"r.{payload_col}"), F.col(f"r.{metadata_col}")
    inner = lambda f: F.get_json_object(p, f"$.memory.{f}")
    return newest.select(
        "memory_id",
        F.get_json_object(p, "$.key").alias("key"),
        F.get_json_object(p, "$.sessionId").alias("session_id"),
        inner("value").alias("value"),
        F.coalesce(inner("category"), F.get_json_object(m, "$.category")).alias("category"),
        F.coalesce(inner("priority"), F.get_json_object(m, "$.priority")).alias("priority"),
    )


def track_access(tracked: DataFrame, accesses: DataFrame) -> DataFrame:
    """Access counts and last accesses after a batch of accesses (memory_id, ms); unknown memories begin at 0."""
    new = accesses.groupBy("memory_id").agg(F.count("*").alias("_n"), F.max("ms").alias("_ms"))
    both = tracked.join(new, "memory_id", "full_outer")
    count = F.coalesce("access_count", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return both.select("memory_id", count.cast("bigint").alias("access_count"), F.greatest("last_ms", "_ms").alias("last_ms"))


def access_scores(tracked: DataFrame, accesses: DataFrame, traits: DataFrame, now_ms: int) -> DataFrame:
    """(memory_id, access_count, last_ms, score) after a batch of accesses: the score of an accessed memory is made anew from
    its counts and the days since it was read, by ``traits`` (memory_id, priority, category); others keep theirs. A memory
    without traits is a note of normal priority."""
    after = track_access(tracked.select("memory_id", "access_count", "last_ms"), accesses)
    read = accesses.select("memory_id").distinct().withColumn("_read", F.lit(True))
    rows = after.join(read, "memory_id", "left").join(traits, "memory_id", "left").join(tracked.select("memory_id", F.col("score").alias("_old")), "memory_id", "left")
    days = (F.lit(now_ms) - F.col("last_ms")) / 86_400_000
    score = sc.relevance(F.coalesce("priority", F.lit("normal")), F.coalesce("category", F.lit("note")), F.col("access_count"), days)
    return rows.select("memory_id", "access_count", "last_ms", F.when(F.col("_read"), score).otherwise(F.col("_old")).alias("score"))


def relevant(scores: DataFrame, saves: DataFrame, least: float = 0.7, limit: int = 100) -> DataFrame:
    """The best scored memories (memory_id, score) with their saves, by the id in each save's JSON payload."""
    own = saves.withColumn("memory_id", F.get_json_object("payload", "$.memoryId").cast(scores.schema["memory_id"].dataType)).drop("payload")
    return scores.filter(F.col("score") >= least).join(own, "memory_id").orderBy(F.desc("score"), "memory_id").limit(limit)


def proactive(hits: DataFrame, relevance: DataFrame, exclude: list[str], limit: int = 5, floor: float = 0.3, least: float = 0.5) -> DataFrame:
    """Related memories to offer: the best hit of each key, the top ones, then those of enough score and relevance.

    ``hits``: key, memory_id, score, value; values are cut at 200 characters. A memory without a relevance has none.
    """
    best = hits.filter(~F.col("key").isin(exclude)).groupBy("key").agg(F.max(F.struct("score", "memory_id", "value")).alias("r")).select("key", "r.*")
    top = best.orderBy(F.desc("score"), "key").limit(limit)
    rows = top.join(relevance, "memory_id", "left").filter((F.col("score") >= floor) & (F.col("relevance") >= least))
    return rows.select("key", "memory_id", "score", F.when(F.length("value") > 200, F.concat(F.substring("value", 1, 200), F.lit("..."))).otherwise(F.col("value")).alias("value"))


def semantic_recall(own: DataFrame, others: DataFrame, floor: float, limit: int, id_col: str = "key") -> DataFrame:
    """Scored rows of the session, then of others whose keys the session hasn't found; the best ones above the floor, 0.2
    at least. Columns id, score."""
    rest = others.join(own.select(id_col).distinct(), id_col, "left_anti")
    rows = own.select(id_col, "score", F.lit(True).alias("in_session")).unionByName(rest.select(id_col, "score", F.lit(False).alias("in_session")))
    return rows.filter(F.col("score") >= max(floor, 0.2)).orderBy(F.desc("score"), id_col).limit(limit)


def formatted(rows: DataFrame, order: list[Column], line: Column, title: str) -> DataFrame:
    """One text: a title with the number of rows, then their lines in order; for short lists, as recall returns them."""
    listed = rows.select(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), line.alias("line")).alias("r")).agg(F.sort_array(F.collect_list("r")).alias("rs"))
    lines = F.transform("rs", lambda r: r["line"])
    return listed.select(F.concat(F.lit(f"{title} ("), F.size("rs").cast("string"), F.lit(")\n"), F.array_join(lines, "\n")).alias("text"))


# ---- alerts and breakers --------------------------------------------------------------------------------------------


def escalate_step(window_ms: int = 900_000):
    """Fire when the window is over, or when the severity turned from warning to critical or back since the last one fired."""

    def step(state, row):
        turned = state is not None and state[1] != row["severity"] and {state[1], row["severity"]} == {"warning", "critical"}
        if state is None or turned or row["ms"] - state[0] >= window_ms:
            return (row["ms"], row["severity"]), True
        return state, False

    return step


def alert_map_step(window_ms: int = 900_000, most: int = 200):
    """A monitor's alerts by name: as ``escalate_step`` for each, of rows (alert, severity, ms); a severity of null clears
    the alert, so that it may fire again at once, and beyond ``most`` alerts the one that fired longest ago goes alike."""
    own = escalate_step(window_ms)

    def step(state, row):
        held = dict(state or {})
        if row["severity"] is None:
            held.pop(row["alert"], None)
            return held, False
        new, fires = own(held.get(row["alert"]), row)
        if fires:
            held.pop(row["alert"], None)
            held[row["alert"]] = new  # last fired last
            if len(held) > most:
                del held[next(iter(held))]
        return held, fires

    return step


def tripped(deliveries: DataFrame, who: str, order: str, failed: Column, most: int = 5) -> DataFrame:
    """(who, at): the first row at which a subscriber has failed ``most`` times in a row."""
    w = Window.partitionBy(who).orderBy(order)
    runs = deliveries.withColumn("_ok", F.sum(F.when(failed, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(failed)
    place = F.row_number().over(Window.partitionBy(who, "_ok").orderBy(order))
    return runs.withColumn("_n", place).filter(F.col("_n") == most).groupBy(who).agg(F.min(order).alias("at"))
