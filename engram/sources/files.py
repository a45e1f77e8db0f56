"""File trees and version-control history as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that a scan skips, and the largest file that it takes.
SKIPPED = ["node_modules", ".git", "dist", "build", "coverage", "__pycache__", ".venv"]
MAX_BYTES = 1 << 20


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, sha256, content): text files below ``root`` of at most 1 MB, without environment files, skipped
    folders and files with a zero byte in their first 8 KB."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).filter(F.col("length") <= MAX_BYTES)
    name = F.element_at(F.split("path", "/"), -1)
    f = f.filter(~name.startswith(".env") & ~F.col("path").rlike("/(" + "|".join(x.replace(".", r"\.") for x in SKIPPED) + ")/"))
    f = f.filter(~F.hex(F.expr("substring(content, 1, 8192)")).rlike("^(..)*00"))
    return f.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.decode("content", "utf-8").alias("content"))


def parse_log(log: DataFrame) -> DataFrame:
    """(commit, author, at, subject, status, path, old_path) from rows (record) of a dumped log.

    A record has the hash, author, ISO time and subject parted by 0x1F, then a line for each file: status, tab, path, and
    for renames and copies the old path before it.
    """
    lines = F.split("record", "\n")
    head = F.split(F.get(lines, 0), "\x1f")
    rows = log.select(F.get(head, 0).alias("commit"), F.get(head, 1).alias("author"), F.get(head, 2).alias("at"), F.get(head, 3).alias("subject"), F.explode_outer(F.filter(F.slice(lines, 2, F.size(lines)), lambda x: x.contains("\t"))).alias("f"))
    part = F.split("f", "\t")
    moved = F.substring("f", 1, 1).isin("R", "C")
    return rows.select("commit", "author", "at", "subject", F.substring("f", 1, 1).alias("status"), F.when(moved, F.get(part, 2)).otherwise(F.get(part, 1)).alias("path"), F.when(moved, F.get(part, 1)).alias("old_path"))


def parse_hunks(diffs: DataFrame) -> DataFrame:
    """(commit, path, old_start, old_lines, new_start, new_lines) from rows (commit, path, diff)."""
    p = r"(?m)^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
    heads = diffs.select("commit", "path", F.explode(F.regexp_extract_all("diff", F.lit(p), F.lit(0))).alias("h"))
    number = lambda i, default: F.when(F.regexp_extract("h", p, i) == "", default).otherwise(F.regexp_extract("h", p, i)).cast("int")
    return heads.select("commit", "path", number(1, "0").alias("old_start"), number(2, "1").alias("old_lines"), number(3, "0").alias("new_start"), number(4, "1").alias("new_lines"))
