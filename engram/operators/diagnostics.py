"""Diagnostics runs: normalised findings, ids and digests, latest runs, severity rollups, diffs, tool comparison,
attribution of findings to symbols. Findings: analysis_id, file_path, start_line, start_col, end_line, end_col, rule_id,
severity, message, fingerprint."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.operators.digests import ordered_sha256
from engram.operators.memory import latest_per
from engram.session import broadcast_if_small, materialize

KEY = ["file_path", "start_line", "start_col", "end_line", "end_col", "rule_id", "severity", "message", "fingerprint"]

#: Different spans of a bin that meet as many in one piece, pairs that a task compares, and tasks at most.
SPANS, PAIRS, MOST_TASKS = 4_096, 1 << 25, 10_000
#: Rows of a piece at most, about, and rows of one span that meet at a time, of the one side and of the other; a task holds the
#: pairs of FEW rows with a piece.
ROWS, FEW, MANY = 32_768, 16, 64


def sort_key() -> Column:
    """The line that a finding is sorted, compared and hashed by; missing numbers are 0, a missing fingerprint empty."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("0" if c.endswith(("line", "col")) else "")) for c in KEY))


def normalized(findings: DataFrame) -> DataFrame:
    f = findings.withColumns({"severity": tx.severity(F.col("severity")), "message": tx.collapse(F.col("message")), "file_path": tx.slashes(F.col("file_path"))})
    f = f.withColumn("sort_key", sort_key())
    return f.withColumn("finding_id", F.sha2(F.concat_ws("\n", F.col("analysis_id").cast("string"), F.col("sort_key")), 256))


def digest(findings: DataFrame, group: str = "analysis_id") -> DataFrame:
    """SHA-256 over a run's ordered lines, which stream through the hash."""
    return ordered_sha256(findings, group, "sort_key", "\n")


def analysis_id(project: Column, tree: Column, tool: Column, version: Column, config: Column, findings: Column) -> Column:
    return tx.content_id(project, tree, tool, version, config, findings)


def latest_runs(runs: DataFrame, *keys: str) -> DataFrame:
    return latest_per(runs, *keys, order=("created_at", "run_id"))


def severity_counts(findings: DataFrame, group: str = "analysis_id") -> DataFrame:
    s = F.col("severity")
    return findings.groupBy(group).agg(F.count("*").alias("total"), F.count_if(s == "error").alias("errors"), F.count_if(s == "warning").alias("warnings"), F.count_if(s == "note").alias("notes"))


def severity_summary(findings: DataFrame) -> DataFrame:
    return findings.groupBy("severity").agg(F.count("*").alias("n"))


def by_symbol(findings: DataFrame) -> DataFrame:
    """Totals by symbol with a severity map as text; unattributed findings have a null symbol."""
    per = findings.groupBy("symbol_id", "severity").agg(F.count("*").alias("n"))
    return per.groupBy("symbol_id").agg(F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "severity", "n"))), ",").alias("severities"))


def by_file(findings: DataFrame) -> DataFrame:
    """Totals by file with the counts of the symbols in it as text."""
    per = findings.groupBy("file_path", "symbol_id").agg(F.count("*").alias("n"))
    return per.groupBy("file_path").agg(F.sum("n").alias("total"), F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", F.coalesce(F.col("symbol_id").cast("string"), F.lit("-")), "n"))), ",").alias("symbols"))


def compare_tools(findings: DataFrame) -> DataFrame:
    """(tool, total, files, overlap_files): files of a tool in which more than one finding of any tool stands."""
    busy = findings.groupBy("file_path").agg(F.count("*").alias("n")).filter("n > 1").select("file_path", F.lit(1).alias("busy"))
    per = findings.groupBy("tool", "file_path").agg(F.count("*").alias("n")).join(busy, "file_path", "left")
    return per.groupBy("tool").agg(F.sum("n").alias("total"), F.count("*").alias("files"), F.count("busy").alias("overlap_files"))


def diff(a: DataFrame, b: DataFrame, key: str = "sort_key") -> DataFrame:
    """(key, status): introduced only in b, resolved only in a, unchanged in both. Keyed by the line, or by finding id."""
    both = a.select(key).distinct().withColumn("in_a", F.lit(1)).join(b.select(key).distinct().withColumn("in_b", F.lit(1)), key, "full_outer")
    return both.select(key, F.when(F.col("in_a").isNull(), "introduced").when(F.col("in_b").isNull(), "resolved").otherwise("unchanged").alias("status"))


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


def _cut(array: str, size: int) -> Column:
    """An array's parts of ``size``."""
    return F.transform(F.sequence(F.lit(1), F.size(array), F.lit(size)), lambda i: F.slice(array, i, size))


def interval_join(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, on: str, width: int = 64, how: str = "inner") -> DataFrame:
    """Points within spans of the same ``on``: equi-join on bins of ``width``, then the exact test. A point lies in one
    bin, so no pair comes twice."""
    s = spans.withColumn("_bin", _bins(F.col(start), F.col(end), width))
    p = points.withColumn("_bin", F.floor(F.col(at) / width))
    return p.join(s, [on, "_bin"]).filter(F.col(at).between(F.col(start), F.col(end))).drop("_bin")


def overlap_join(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], on: str, width: int = 64) -> DataFrame:
    """Overlapping spans: equi-join on bins, each pair in the bin where the later of the two starts.

    Few rows can make many pairs, so work is dealt by pairs: bins are counted first, those of more than SPANS different spans
    or ROWS rows a side are cut into pieces, and the pieces go to a task for every PAIRS pairs. Rows of a piece with the same
    span are one row, of an array, until it has met its partners: they are compared once, and what is copied for another piece
    is little more than their other columns. Their pairs come out part by part in order, which files hold in few bytes.
    """
    bins = lambda span: _bins(F.col(span[0]), F.col(span[1]), width)
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    counted = lambda df, span, m, n: df.select(on, bins(span).alias("_bin"), F.col(span[0]).alias("_from"), F.col(span[1]).alias("_to"), m.alias("m"), n.alias("n"))
    sizes = counted(a, a_span, one, none).unionByName(counted(b, b_span, none, one)).groupBy(on, "_bin", "_from", "_to").agg(F.sum("m").alias("m"), F.sum("n").alias("n"))
    sizes = sizes.groupBy(on, "_bin").agg(F.count_if(F.col("m") > 0).alias("p"), F.count_if(F.col("n") > 0).alias("q"), F.sum("m").alias("m"), F.sum("n").alias("n")).filter("m > 0 and n > 0")
    pieces = [F.greatest(F.ceil(F.col(spans) / SPANS), F.ceil(F.col(rows) / ROWS)).cast("int").alias(name) for spans, rows, name in (("p", "m", "_rows"), ("q", "n", "_columns"))]
    plan = materialize(sizes.select(on, "_bin", (F.col("m") * F.col("n")).alias("_pairs"), *pieces), "bins")
    pairs, met = plan.agg(F.sum("_pairs"), F.sum(F.col("_rows").cast("bigint") * F.col("_columns"))).first()
    tasks = max(1, min(MOST_TASKS, met or 0, -(-(pairs or 0) // PAIRS)))
    plan = broadcast_if_small(plan.drop("_pairs"))

    def blocks(df: DataFrame, span: tuple[str, str], own: str, pieces: str, other: str, others: str, held: str) -> DataFrame:
        rest = [c for c in df.columns if c not in (on, *span)] or [span[0]]
        rows = df.withColumn("_bin", bins(span)).join(plan, [on, "_bin"]).withColumn(own, F.pmod(F.xxhash64(*df.columns), pieces).cast("int"))
        rows = rows.groupBy(on, "_bin", own, others, *span).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(held))
        # a single column is held as it is, in place of rows
        return rows.select(on, "_bin", own, F.explode(F.sequence(F.lit(0), F.col(others) - 1)).alias(other), *span, (F.col(held)[rest[0]] if len(rest) == 1 else F.col(held)).alias(held))

    keys = [on, "_bin", "_row", "_column"]
    x = blocks(a, a_span, "_row", "_rows", "_column", "_columns", "_x").repartition(tasks, *keys)
    y = blocks(b, b_span, "_column", "_columns", "_row", "_rows", "_y").repartition(tasks, *keys)
    first = lambda span: F.floor(F.col(span[0]) / width)
    hit = (F.col(a_span[0]) <= F.col(b_span[1])) & (F.col(b_span[0]) <= F.col(a_span[1])) & (F.greatest(first(a_span), first(b_span)) == F.col("_bin"))
    # a broadcast side would leave all pairs to the other side's few tasks
    x, y = x.withColumn("_x", F.explode(_cut("_x", FEW))), y.withColumn("_y", F.explode(_cut("_y", MANY)))
    met = x.hint("merge").join(y, keys).filter(hit).withColumn("_x", F.explode("_x")).withColumn("_y", F.explode("_y"))

    def columns(df: DataFrame, span: tuple[str, str], held: str) -> list[Column]:
        rest = [c for c in df.columns if c not in (on, *span)]
        return [F.col(c) if c in span else F.col(held).alias(c) if len(rest) == 1 else F.col(f"{held}.{c}") for c in df.columns if c != on]

    return met.select(on, *columns(a, a_span, "_x"), *columns(b, b_span, "_y"))


def attribute(findings: DataFrame, symbols: DataFrame, finding_id: str = "finding_id") -> DataFrame:
    """Each finding with the innermost symbol around its line (smallest span, then smallest id), or null."""
    hits = interval_join(findings.select(finding_id, "file_path", "start_line"), symbols.select("file_path", "symbol_id", "sym_start", "sym_end"), "start_line", "sym_start", "sym_end", "file_path")
    best = hits.groupBy(finding_id).agg(F.min(F.struct((F.col("sym_end") - F.col("sym_start")).alias("span"), "symbol_id")).alias("s"))
    return findings.join(best.select(finding_id, F.col("s.symbol_id").alias("symbol_id")), finding_id, "left")


def tree_hash(files: DataFrame, group: str) -> DataFrame:
    """SHA-256 over a project's ordered path and content hash lines, which stream through the hash."""
    line = F.concat(F.col("path"), F.lit("\n"), F.col("sha256"), F.lit("\n"))
    return ordered_sha256(files.select(group, line.alias("line")), group, "line", "", "tree_hash")


def top_files(findings: DataFrame, k: int = 5) -> DataFrame:
    return findings.groupBy("file_path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "file_path").limit(k)


def parse_sarif(raw: DataFrame) -> DataFrame:
    """Findings of SARIF texts (id, sarif): every run's results, the first location, the usual fingerprint first.

    Unreadable texts give no rows.
    """
    region = "region struct<startLine: int, startColumn: int, endLine: int, endColumn: int>"
    place = f"array<struct<physicalLocation: struct<artifactLocation: struct<uri: string>, {region}>>>"
    prints = "struct<primaryLocationLineHash: string>"
    result = f"struct<message: struct<text: string>, ruleId: string, rule: struct<id: string>, level: string, locations: {place}, fingerprints: {prints}, partialFingerprints: {prints}>"
    schema = f"runs array<struct<tool: struct<driver: struct<name: string, version: string>>, results: array<{result}>>>"
    r = raw.select("id", F.explode(F.from_json("sarif", schema).runs).alias("run")).select("id", "run.tool.driver.*", F.explode("run.results").alias("x"))
    spot = F.get(F.col("x.locations"), 0).physicalLocation
    return r.select(
        "id",
        F.col("name").alias("tool"),
        F.col("version").alias("tool_version"),
        F.coalesce("x.ruleId", "x.rule.id", F.lit("unknown")).alias("rule_id"),
        tx.severity(F.coalesce("x.level", F.lit("info"))).alias("severity"),
        F.coalesce("x.message.text", F.lit("")).alias("message"),
        F.regexp_replace(F.coalesce(spot.artifactLocation.uri, F.lit("")), "^file://", "").alias("file_path"),
        spot.region.startLine.alias("start_line"),
        spot.region.startColumn.alias("start_col"),
        spot.region.endLine.alias("end_line"),
        spot.region.endColumn.alias("end_col"),
        F.coalesce("x.fingerprints.primaryLocationLineHash", "x.partialFingerprints.primaryLocationLineHash").alias("fingerprint"),
    )
