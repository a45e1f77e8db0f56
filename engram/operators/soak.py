"""Soak monitoring: how long all hard gates have been green, when the soak began anew, and whether it is clean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def soak(days: DataFrame, streak: int = 30, soft: int = 24, span: int = 30) -> DataFrame:
    """(day, soak_start, streak, soft_green, clean) of rows (day: a number, gate, hard, green), one a day and gate.

    A hard gate that is red on two days that follow one another resets ``soak_start`` to the second; before any reset it is
    the first day. ``streak``: days up to this one on which all hard gates were green, a day without rows ends it.
    ``soft_green``: the least number of green days of a soft gate among the last ``span``, ``span`` without soft gates. clean:
    a streak of ``streak`` days since the soak began and ``soft`` green days of each soft gate. A null is red.
    """
    rows = days.select("day", "gate", "hard", F.coalesce("green", F.lit(False)).alias("green"))
    own = Window.partitionBy("gate").orderBy("day")
    again = F.col("hard") & ~F.col("green") & F.coalesce((F.lag("day").over(own) == F.col("day") - 1) & ~F.lag("green").over(own), F.lit(False))
    near = own.rangeBetween(-(span - 1), 0)
    rows = rows.withColumns({"reset": again, "greens": F.sum(F.col("green").cast("int")).over(near)})
    by = rows.groupBy("day").agg(
        F.max("reset").alias("reset"),
        F.coalesce(F.min(F.when(F.col("hard"), F.col("green"))), F.lit(True)).alias("all_green"),
        F.coalesce(F.min(F.when(~F.col("hard"), F.col("greens"))), F.lit(span)).alias("soft_green"),
    )
    line = Window.partitionBy(F.lit(0)).orderBy("day")  # a row a day
    past = line.rowsBetween(Window.unboundedPreceding, 0)
    by = by.withColumn("follows", F.coalesce(F.lag("day").over(line) == F.col("day") - 1, F.lit(False)))
    # the day before the streak: a red one, or the one before a gap
    before = F.max(F.when(~F.col("all_green"), F.col("day")).when(~F.col("follows"), F.col("day") - 1)).over(past)
    by = by.select("day", F.coalesce(F.max(F.when(F.col("reset"), F.col("day"))).over(past), F.min("day").over(past)).alias("soak_start"), (F.col("day") - before).cast("int").alias("streak"), F.col("soft_green").cast("int").alias("soft_green"))
    clean = (F.least("streak", F.col("day") - F.col("soak_start") + 1) >= streak) & (F.col("soft_green") >= soft)
    return by.withColumn("clean", clean)
