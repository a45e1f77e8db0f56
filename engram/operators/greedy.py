"""Greedy segmentation of ordered rows: where runs begin if each run takes all it may, for keys of any size.

A run that begins at a row ends before the first later row whose value reaches the row's bound. So every row has one next
start, found by a merge of values and bounds in order; and the starts are the rows on the chain from each key's first one,
found by doubling: after k rounds every row knows the row 2^k starts on, and marked rows mark these. All steps are joins and
ranges of sorted rows, so a key with a third of all rows is spread as others are, and rounds grow with the logarithm of the
longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.session import broadcast_if_small, materialize

ROUNDS = 64
#: Rows of a range, and of a side of a task of a join, about.
ROWS = 1 << 18


def _parts(rows: DataFrame) -> int:
    """In how many parts written rows are dealt: their size doesn't grow with the table."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // ROWS))


def _ranged(rows: DataFrame, parts: int, *order: Column | str) -> DataFrame:
    """``rows`` with the number of their range of ``order``, written."""
    return materialize(rows.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranged")


def _joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Written rows joined. ``right`` is broadcast if its rows are small, else both are dealt by their number and sorted: files
    of numbers that rise have next to no bytes, so that Spark would broadcast millions of rows by the size of their files."""
    small = broadcast_if_small(right)
    if small is not right:
        return left.join(small, on, how)
    parts = max(_parts(left), _parts(right))
    return left.repartition(parts, *on).join(right.repartition(parts, *on).hint("merge"), on, how)


def running(rows: DataFrame, key: str, order: list[str], **sums: Column) -> DataFrame:
    """``rows`` with running sums within ``key`` in ``order``, the row itself included; the order must be total for the sums
    to be the same each time. Null keys are one key; a key's ranges are summed apart and meet by one row each."""
    rows = materialize(rows.withColumns({f"_{n}": c for n, c in sums.items()}), "rows")
    parts = _parts(rows)
    placed = _ranged(rows, parts, key, *order)
    totals = placed.groupBy(key, "_range").agg(*(F.sum(f"_{n}").alias(f"_t_{n}") for n in sums))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    first = materialize(totals.select(F.col(key).alias("_key"), F.col("_range").alias("_r"), *(F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in sums)), "before")
    inside = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.repartition(parts, "_range", key).join(broadcast_if_small(first), (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_key")))
    return out.withColumns({n: F.col(f"_b_{n}") + F.sum(f"_{n}").over(inside) for n in sums}).drop("_range", "_r", "_key", *(f"_{n}" for n in sums), *(f"_b_{n}" for n in sums))


def next_starts(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos, next) of rows (key, pos, value, bound): the least later ``pos`` whose value is at least the row's bound.

    ``rows`` are written; ``pos`` counts a key's rows from 1, values don't fall along it. The next row, if the bound is the row's own value or less.
    """
    value = rows.select(key, F.col("value").alias("x"), F.lit(1).alias("point"), "pos")
    bound = rows.select(key, F.col("bound").alias("x"), F.lit(0).alias("point"), "pos")
    parts = 2 * _parts(rows)
    both = _ranged(value.unionByName(bound), parts, key, "x", "point", "pos")
    point = F.when(F.col("point") == 1, F.col("pos"))
    later = Window.partitionBy(key).orderBy("_range").rowsBetween(1, Window.unboundedFollowing)
    ahead = both.groupBy(key, "_range").agg(F.min(point).alias("p"))
    ahead = materialize(ahead.select(F.col(key).alias("_key"), F.col("_range").alias("_r"), F.min("p").over(later).alias("_ahead")), "ahead")
    back = Window.partitionBy("_range", key).orderBy(F.desc("x"), F.desc("point"), F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    met = both.repartition(parts, "_range", key).withColumn("_met", F.last(point, ignorenulls=True).over(back)).filter("point = 0")
    met = met.join(broadcast_if_small(ahead), (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_key")))
    found = F.coalesce("_met", "_ahead")
    return met.select(key, "pos", F.when(found.isNotNull(), F.greatest(found, F.col("pos") + 1)).alias("next"))


def starts(rows: DataFrame, key: str) -> DataFrame:
    """(key, pos) of the written rows (key, pos, value, bound) at which runs begin, the first of each key among them."""
    named = rows.withColumn(key, F.struct(F.col(key)))  # a null key is a key
    jump = materialize(next_starts(named, key).filter("next is not null"), "jump")
    marked = materialize(named.filter("pos = 1").select(key, "pos"), "marked")
    for _ in range(ROUNDS):
        if jump.isEmpty():
            break
        reached = _joined(jump, marked, [key, "pos"]).select(key, F.col("next").alias("pos"))
        marked = materialize(marked.unionByName(reached).repartition(_parts(marked), key, "pos").distinct(), "marked")
        on = jump.select(key, F.col("pos").alias("next"), F.col("next").alias("after"))
        jump = materialize(_joined(jump, on, [key, "next"]).select(key, "pos", F.col("after").alias("next")), "jump")
    return marked.select(F.col(f"{key}.{key}").alias(key), "pos")


# ---- what runs are of -----------------------------------------------------------------------------------------------


def packed_lines(files: DataFrame, path_col: str = "file_path", text_col: str = "content", limit: int = 32_000, overlap: int = 2) -> DataFrame:
    """(path, part, first_line, last_line, content) of each file's parts of whole lines: as many as make ``limit`` characters
    with the breaks between them, one at least; parts share ``overlap`` lines on either side beyond this.

    Paths are unique; a null path or text gives no part, an empty text one part of an empty line. A file's lines are rows
    of their own until its parts are known; the content is cut from the text.
    """
    files = files.filter(F.col(path_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(path_col).alias("path"), F.split(text_col, "\n", -1).alias("lines"))
    each = files.select("path", F.size("lines").alias("n"), F.posexplode(F.transform("lines", lambda x: F.length(x).cast("bigint"))).alias("i", "size"))
    each = each.select("path", (F.col("i") + 1).cast("bigint").alias("pos"), "size", "n")
    sums = running(each, "path", ["pos"], total=F.col("size") + 1)
    # from its own begin to its end with breaks between, a line makes more than the limit as soon as value >= bound
    rows = materialize(sums.select("path", "pos", "n", F.col("total").alias("value"), (F.col("total") - F.col("size") + limit + 1).alias("bound")), "lines")
    begin = _joined(rows.select("path", "pos", "n"), starts(rows.select("path", "pos", "value", "bound"), "path"), ["path", "pos"])
    w = Window.partitionBy("path").orderBy("pos")  # the parts of a file
    part = begin.select("path", F.row_number().over(w).alias("part"), "pos", "n", (F.coalesce(F.lead("pos").over(w), F.col("n") + 1) - 1).alias("end"))
    first = F.when(F.col("part") > 1, F.greatest(F.lit(1), F.col("pos") - overlap)).otherwise(1).cast("int")
    part = part.select("path", "part", first.alias("first_line"), F.least(F.col("n"), F.col("end") + overlap).cast("int").alias("last_line"))
    cut = F.array_join(F.slice("lines", F.col("first_line"), F.col("last_line") - F.col("first_line") + 1), "\n")
    return part.join(files, "path").select("path", "part", "first_line", "last_line", cut.alias("content"))


def _timed(rows: DataFrame, key: str, window_ms: int, order: str) -> DataFrame:
    """Rows with their number in time within the key, and when their window ends."""
    placed = running(rows.withColumn("_time", F.col("ms")), key, ["ms", order], pos=F.lit(1).cast("bigint"))
    return materialize(placed.withColumns({"value": F.col("ms"), "bound": F.col("ms") + window_ms}), "timed")


def _begun(timed: DataFrame, key: str) -> DataFrame:
    """``timed`` with ``_p``, the row's number if a run begins at it."""
    begin = starts(timed.select(key, "pos", "value", "bound"), key).select(F.struct(key).alias("_k"), "pos", F.col("pos").alias("_p"))
    return _joined(timed.withColumn("_k", F.struct(key)), begin, ["_k", "pos"], "left")


def accepted(rows: DataFrame, key: str, window_ms: int, order: str = "event_id") -> DataFrame:
    """``rows`` (key, ms, order) with ``accepted``: whether none was accepted less than ``window_ms`` before, in order of time."""
    return _begun(_timed(rows, key, window_ms, order), key).select(*rows.columns, F.col("_p").isNotNull().alias("accepted"))


def rate_limited(rows: DataFrame, key: str, limit: int, window_ms: int, order: str = "event_id") -> DataFrame:
    """``rows`` with ``accepted``: the first ``limit`` of each window, which opens with the first row after the last one ended."""
    timed = _timed(rows, key, window_ms, order)
    parts = _parts(timed)
    # the last start up to a row, by a running maximum over ranges: starts' places don't fall along the key
    placed = _ranged(_begun(timed, key), parts, key, "pos")
    tops = placed.groupBy(key, "_range").agg(F.max("_p").alias("m"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    tops = materialize(tops.select(F.col(key).alias("_key"), F.col("_range").alias("_r"), F.max("m").over(before).alias("_before")), "tops")
    inside = Window.partitionBy("_range", key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = placed.repartition(parts, "_range", key).join(broadcast_if_small(tops), (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_key")))
    opened = F.coalesce(F.max("_p").over(inside), F.col("_before"))
    return out.withColumn("_opened", opened).select(*rows.columns, (F.col("pos") - F.col("_opened") < limit).alias("accepted"))
