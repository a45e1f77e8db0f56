"""Bi-temporal entities: versions, as-of reads, evolution, correlated changes, commit timelines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def versions(rows: DataFrame, entity: str, at: str, tie: str) -> DataFrame:
    """SCD-2: version number and validity of each row; a version ends where the next begins."""
    w = Window.partitionBy(entity).orderBy(at, tie)
    return rows.withColumns({"version": F.row_number().over(w), "valid_from": F.col(at), "valid_to": F.lead(at).over(w)})


def as_of(history: DataFrame, entity: str, moment: Column) -> DataFrame:
    """The version of each entity that is valid at a moment, the newest if several are."""
    valid = (F.col("valid_from") <= moment) & (F.col("valid_to").isNull() | (F.col("valid_to") > moment))
    rest = [c for c in history.columns if c not in (entity, "version")]
    rows = history.filter(valid).groupBy(entity).agg(F.max(F.struct("version", *rest)).alias("r"))
    return rows.select(entity, "r.*")


def changes(history: DataFrame, entity: str) -> DataFrame:
    """created for the first version, deleted for a later closed one, updated for a later open one."""
    kind = F.when(F.col("version") == 1, "created").when(F.col("valid_to").isNotNull(), "deleted").otherwise("updated")
    return history.withColumn("change", kind)


def correlated(a: DataFrame, b: DataFrame, at: str, band: int, on: str | None = None) -> DataFrame:
    """Pairs of changes within ``band`` of each other, by an equi-join on time bins and the exact test.

    Each row of b goes to the bins next to its own, so a pair is found in one bin.
    """
    x = a.select(*(F.col(c).alias(f"a_{c}") for c in a.columns)).withColumn("_bin", F.floor(F.col(f"a_{at}") / band))
    y = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns)).withColumn("_bin", F.explode(F.array(*(F.floor(F.col(f"b_{at}") / band) + i for i in (-1, 0, 1)))))
    keys = x["_bin"] == y["_bin"]
    if on:
        keys = keys & (F.col(f"a_{on}") == F.col(f"b_{on}"))
    gap = F.abs(F.col(f"a_{at}") - F.col(f"b_{at}"))
    return x.join(y, keys).filter(gap <= band).drop("_bin").withColumn("gap", gap)


def explicit_why(message: Column) -> Column:
    """The lines of a commit message that give a reason, else its first line."""
    lines = F.transform(F.split(message, "\n"), lambda x: F.trim(x))
    starts = ("Why:", "Reason:", "Fixes #", "Closes #", "Refs #", "References:")

    def tells(x: Column) -> Column:
        hit = x.rlike(r"ADR-\d+") | x.rlike(r"\(#\d+\)")
        for s in starts:
            hit = hit | x.startswith(s)
        return hit

    found = F.filter(lines, tells)
    return F.when(F.size(found) > 0, F.array_join(found, "; ")).otherwise(F.coalesce(F.get(lines, 0), F.lit("")))


def islands(rows: DataFrame, partition: str, order: list[str], same: Column) -> DataFrame:
    """Adds ``island``: a running number that grows where ``same`` (against the row before) is false or null."""
    w = Window.partitionBy(partition).orderBy(*order)
    new = F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)
    marked = rows.withColumn("_new", new)
    return marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def store_version(history: DataFrame, new: DataFrame, entity: str, now: int) -> DataFrame:
    """The history after new states (entity and its fields): open versions of those entities close now, and the next opens.

    Columns of history: entity, version, valid_from, valid_to and the fields. An entity without a history gets version 1.
    """
    fields = [c for c in new.columns if c != entity]
    last = history.groupBy(entity).agg(F.max("version").alias("_last"))
    ids = new.select(entity).distinct().withColumn("_new", F.lit(True))
    closed = history.join(ids, entity, "left")
    closed = closed.withColumn("valid_to", F.when(F.col("_new") & F.col("valid_to").isNull(), F.lit(now)).otherwise(F.col("valid_to"))).drop("_new")
    opened = new.join(last, entity, "left").select(entity, (F.coalesce("_last", F.lit(0)) + 1).alias("version"), F.lit(now).alias("valid_from"), F.lit(None).cast("bigint").alias("valid_to"), *fields)
    return closed.unionByName(opened.select(*closed.columns))


def invalidate(history: DataFrame, gone: DataFrame, entity: str, now: int) -> DataFrame:
    """The history with the open versions of some entities closed now; nothing is deleted."""
    ids = gone.select(entity).distinct().withColumn("_gone", F.lit(True))
    out = history.join(ids, entity, "left")
    return out.withColumn("valid_to", F.when(F.col("_gone") & F.col("valid_to").isNull(), F.lit(now)).otherwise(F.col("valid_to"))).drop("_gone")


def update_in_place(history: DataFrame, changes: DataFrame, entity: str) -> DataFrame:
    """The history with fields of the open versions replaced by those of ``changes`` that aren't null; versions stay."""
    fields = [c for c in changes.columns if c != entity]
    out = history.join(changes.select(entity, F.struct(*fields).alias("_c")), entity, "left")
    is_open = F.col("valid_to").isNull() & F.col("_c").isNotNull()
    return out.withColumns({f: F.when(is_open, F.coalesce(F.col(f"_c.{f}"), F.col(f))).otherwise(F.col(f)) for f in fields}).drop("_c")


def as_known(history: DataFrame, entity: str, moment: Column, event_time: str = "event_time") -> DataFrame:
    """``as_of`` of the versions whose event has happened by then."""
    return as_of(history.filter(F.col(event_time) <= moment), entity, moment)


def version_pairs(history: DataFrame, entity: str, fields: list[str]) -> DataFrame:
    """Each version beside the one before: columns prev_<field>, null for the first."""
    w = Window.partitionBy(entity).orderBy("version")
    return history.withColumns({f"prev_{f}": F.lag(f).over(w) for f in fields})


def evolution(history: DataFrame, entity: str, start=None, end=None, kinds: list[str] | None = None, limit: int = 100) -> DataFrame:
    """The newest changes of entities within a time span and of some kinds."""
    out = changes(history, entity)
    if start is not None:
        out = out.filter(F.col("valid_from") >= start)
    if end is not None:
        out = out.filter(F.col("valid_from") <= end)
    if kinds:
        out = out.filter(F.col("change").isin(kinds))
    return out.orderBy(F.desc("valid_from"), entity, F.desc("version")).limit(limit)


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; only ranks up to n are kept by the sort of each task and of the group."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)


def compare_evolution(a: DataFrame, b: DataFrame, at: str, band: int) -> DataFrame:
    """(only_a, only_b, correlated): numbers of changes of two entities that no change of the other is near, and of pairs."""
    a, b = a.withColumn("_id", F.monotonically_increasing_id()), b.withColumn("_id", F.monotonically_increasing_id())
    pairs = correlated(a.select("_id", at), b.select("_id", at), at, band).agg(F.count("*").alias("correlated"), F.count_distinct("a__id").alias("_a"), F.count_distinct("b__id").alias("_b"))
    sizes = a.agg(F.count("*").alias("_na")).crossJoin(b.agg(F.count("*").alias("_nb")))  # one row each
    return pairs.crossJoin(sizes).select((F.col("_na") - F.col("_a")).alias("only_a"), (F.col("_nb") - F.col("_b")).alias("only_b"), "correlated")
