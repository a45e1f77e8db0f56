"""Writes of several tables at once, on ``sources.store``: event batches, diagnostic runs, manifests, the maintenance cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.operators import events as ev
from engram.operators import memory as mem
from engram.operators import scoring as sc
from engram.operators.greedy import running
from engram.session import materialize
from engram.sources.store import Conflict, Snapshot, Store

DAY_MS = 86_400_000


class Rejected(ValueError):
    """A batch that breaks a rule of its table; none of it was taken."""


def numbered(rows: DataFrame, *order: str, name: str = "n") -> DataFrame:
    """``rows`` with their number from 0 in ``order``, which must be total for the numbers to be the same each time.

    Ranges of the order are numbered apart, and each begins where the ranges before it end, of which one count each is
    known; so no task sees all rows.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()), "numbered")
    counts = sorted((r["_range"], r["count"]) for r in placed.groupBy("_range").count().collect())  # a row for each range
    starts, total = [], 0
    for r, n in counts:
        starts.append((r, total))
        total += n
    first = spark.createDataFrame(starts or [(0, 0)], "_range int, _first bigint")
    at = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return placed.withColumn("_at", at).join(F.broadcast(first), "_range").withColumn(name, F.col("_first") + F.col("_at")).drop("_range", "_at", "_first")


def with_ids(rows: DataFrame, order: str, name: str = "id") -> DataFrame:
    """``rows`` (ms, ...) with time-sortable ids that rise by ``order``, a total order, within a millisecond.

    A millisecond's rows are numbered from 0 by running sums over ranges, so neither a busy one nor all rows meet in a task;
    the number has 12 bits, and from 4,096 rows on goes on into the milliseconds that follow.
    """
    placed = running(rows, "ms", [order], _seq=F.lit(1).cast("bigint"))
    seq = F.col("_seq") - 1
    return placed.withColumn(name, tx.uuid7(F.col("ms") + F.floor(seq / 4096), seq, F.col(order))).drop("_seq")


def append_batch(store: Store, batch: DataFrame, table: str = "events", key: str = "event_id", attempts: int = 10) -> Snapshot:
    """Add a batch of events with ids of their own, all or none.

    Rejected if an id is null, stands twice in the batch or is there already. The batch is written once and checked as
    written; if the table changes meanwhile it is checked again against what came.
    """
    folder, schema = store.stage(batch)
    rows = store.spark.read.schema(batch.schema).parquet(f"{store.path}/data/{folder}")
    twice = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col(key).isNull() | (F.col("n") > 1)).select(key).first()
    if twice is not None:
        raise Rejected(f"{key} {twice[0]} is missing or stands twice in the batch")
    for _ in range(attempts):
        base = store.at()
        if base.parts(table):
            known = base.table(table)
            if known.schema.simpleString() != rows.schema.simpleString():
                raise Rejected(f"{table} has {known.schema.simpleString()}, not {rows.schema.simpleString()}")
            met = known.join(rows.select(key), key, "left_semi").select(key).first()
            if met is not None:
                raise Rejected(f"{key} {met[0]} is in {table} already")
        try:
            return store.publish({table: ("append", folder, schema)}, base, reads=[table])
        except Conflict:
            continue
    raise Conflict(f"{table} changed {attempts} times meanwhile")


# ---- diagnostics ----------------------------------------------------------------------------------------------------


def save_run(store: Store, runs: DataFrame, findings: DataFrame) -> Snapshot:
    """Add runs (analysis_id, run_id, ...) with their findings (analysis_id, run_id, ...) in one commit.

    Both tables only grow: a run takes the place of its analysis' earlier ones as ``current_runs`` and ``current_findings``
    read them, so a save costs what it adds. Findings of no run in the batch are rejected.
    """
    stray = findings.join(runs.select("analysis_id", "run_id"), ["analysis_id", "run_id"], "left_anti").first()
    if stray is not None:
        raise Rejected(f"a finding of run {stray['run_id']}, which isn't saved with it")
    return store.commit(append={"runs": runs, "findings": findings})


def current_runs(snap: Snapshot, order: tuple[str, ...] = ("created_at", "run_id")) -> DataFrame:
    """The last run of each analysis."""
    return mem.latest_per(snap.table("runs"), "analysis_id", order=order)


def current_findings(snap: Snapshot, order: tuple[str, ...] = ("created_at", "run_id")) -> DataFrame:
    """The findings of each analysis' last run."""
    last = current_runs(snap, order).select("analysis_id", "run_id")
    return snap.table("findings").join(last, ["analysis_id", "run_id"], "left_semi")


# ---- manifests ------------------------------------------------------------------------------------------------------


def save_manifest(store: Store, project: str, files: DataFrame) -> Snapshot:
    """The files (path, sha256, bytes) that a project has now take the place of its last manifest; other projects' stay."""
    name = f"manifest-{project}"
    return store.commit(replace={name: files.select("path", "sha256", F.col("bytes").cast("bigint").alias("bytes"))})


def load_manifest(snap: Snapshot, project: str) -> DataFrame:
    """A project's manifest; one that was never saved is empty."""
    name = f"manifest-{project}"
    if not snap.parts(name):
        return snap.store.spark.createDataFrame([], "path string, sha256 string, bytes bigint")
    return snap.table(name)


# ---- maintenance ----------------------------------------------------------------------------------------------------

EVENTS = "event_id bigint, ms bigint, session_id bigint, event_type string, key bigint, value double, other bigint, reason string"


def maintain(store: Store, now_ms: int, days: int = 30, stale_below: float = 0.3, stale_days: float = 14, prune_below: float = 0.2, prune_days: float = 30, dry_run: bool = False) -> Snapshot:
    """One maintenance cycle over tables events (EVENTS) and relevance (memory_id, priority, category, accesses, last_ms,
    score): dedup, consolidate, prune, retention and rescoring, all in one version; ``dry_run`` only reports.

    A memory is superseded by an event of its own (``other`` is the memory): older saves of a key for the newest
    (maintenance-dedup); stale ones, a digest of up to twenty of a category taking their place (maintenance-consolidate); else
    ones never read, of a low score and long unread (maintenance-prune). What was superseded before stays so and is not named
    again, so a second cycle at the same time changes nothing. Superseded memories leave relevance, the others get the score
    of ``now_ms``. ``cycles`` gets (at_ms, step, n). Memories are the saves that relevance or the log names; null keys are
    superseded by nothing.
    """
    base = store.at()
    log, rel = base.table("events"), base.table("relevance")
    gone = log.filter("event_type = 'MEMORY_SUPERSEDED'").select(F.col("other").alias("memory_id")).distinct()
    saves = log.filter("event_type = 'MEMORY_SAVED'").select(F.col("event_id").alias("memory_id"), "key", "session_id", "value")
    old = mem.supersedes(log.filter("key is not null")).select(F.col("event_id").alias("memory_id")).join(gone, "memory_id", "left_anti")
    dedup = materialize(old.withColumn("reason", F.lit("maintenance-dedup")), "dedup")
    unread = (F.lit(now_ms) - F.col("last_ms")) / DAY_MS
    left = rel.join(gone.unionByName(dedup.select("memory_id")), "memory_id", "left_anti").withColumn("days", unread)
    stale = materialize(sc.stale(left, stale_below, stale_days).select("memory_id", "category", F.lit("maintenance-consolidate").alias("reason")), "stale")
    prune = sc.prunable(left.join(stale, "memory_id", "left_anti"), prune_below, prune_days)
    prune = materialize(prune.select("memory_id", F.lit("maintenance-prune").alias("reason")), "prune")
    out = dedup.unionByName(stale.drop("category")).unionByName(prune)
    facts = stale.join(saves, "memory_id", "left").select("category", "memory_id", F.coalesce(F.col("key").cast("string"), F.lit("unknown")).alias("key"), F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))
    digests = sc.digests(facts, ["category"], "memory_id").select(F.lit(now_ms).alias("at_ms"), "category", "part", "n", "digest")
    kept = ev.retained(log, now_ms, days, noisy="MEMORY_RECALLED")
    keep = lambda df: materialize(df, "kept")
    scored = left.join(out.select("memory_id"), "memory_id", "left_anti")
    scored = keep(scored.withColumn("score", sc.relevance(F.col("priority"), F.col("category"), F.col("accesses"), F.col("days"))).select(*rel.columns))
    steps = {"dedup": dedup, "consolidate": stale, "digests": digests, "prune": prune, "retention": log.join(kept.select("event_id"), "event_id", "left_anti"), "rescore": scored}
    report = None
    for i, (step, df) in enumerate(steps.items()):
        row = df.agg(F.lit(now_ms).alias("at_ms"), F.lit(i).alias("place"), F.lit(step).alias("step"), F.count("*").alias("n"))
        report = row if report is None else report.unionByName(row)
    report = keep(report)
    if dry_run:
        return store.commit(append={"cycles": report}, base=base)
    last = log.agg(F.coalesce(F.max("event_id"), F.lit(0))).first()[0]
    marks = numbered(out.join(saves, "memory_id", "left"), "memory_id")
    marks = marks.select((F.col("n") + last + 1).alias("event_id"), F.lit(now_ms).alias("ms"), "session_id", F.lit("MEMORY_SUPERSEDED").alias("event_type"), "key", F.lit(None).cast("double").alias("value"), F.col("memory_id").alias("other"), "reason")
    expired = report.filter("step = 'retention'").first()["n"]
    append, replace = {"cycles": report, "digests": digests}, {"relevance": scored}
    if expired:
        replace["events"] = kept.select(*log.columns).unionByName(marks.select(*log.columns))
    else:
        append["events"] = marks.select(*log.columns)
    return store.commit(append, replace, base, reads=["events", "relevance"])
