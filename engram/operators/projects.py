"""Projects and runs: inventories, coverage, counts, diagnostics stores, manifests, learning propagation, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.operators.diagnostics import latest_runs

#: Columns that an inventory may be sorted by, with the order of each.
SORTS = {"name": "asc", "files": "desc", "commits": "desc", "updated_ms": "desc"}


def inventory(projects: DataFrame, sort_by: str = "updated_ms", limit: int = 100, roots: DataFrame | None = None) -> DataFrame:
    """Projects in the order of an allowed column, those of registered roots (root) if there are any; others raise."""
    if sort_by not in SORTS:
        raise ValueError(f"can't sort by {sort_by!r}; one of {sorted(SORTS)}")
    if roots is not None:
        projects = projects.join(roots.select("root").distinct(), "root", "left_semi")
    order = F.asc(sort_by) if SORTS[sort_by] == "asc" else F.desc(sort_by)
    return projects.orderBy(order, "root").limit(max(1, min(limit, 1000)))


def counts(**tables: DataFrame) -> DataFrame:
    """(project, one count for each table): projects that any table has, 0 where a table has none."""
    parts = [df.groupBy("project").agg(F.count("*").alias("n")).withColumn("_t", F.lit(name)) for name, df in tables.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("project").agg(*(F.coalesce(F.sum(F.when(F.col("_t") == name, F.col("n"))), F.lit(0)).alias(name) for name in tables))


def coverage(projects: DataFrame) -> DataFrame:
    """(worst, pct, mean): the project of least ingested / actual, whose share is 1 where nothing is there to ingest."""
    pct = F.when(F.col("actual") == 0, 1.0).otherwise(F.col("ingested") / F.col("actual"))
    return projects.withColumn("pct", pct).agg(F.min(F.struct("pct", "project")).alias("w"), F.avg("pct").alias("mean")).select(F.col("w.project").alias("worst"), F.col("w.pct").alias("pct"), "mean")


def confidence(patterns: DataFrame, least: float = 0.5) -> DataFrame:
    """(mean, confident, n): 0 rather than null without patterns."""
    c = F.col("confidence")
    return patterns.agg(F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"), F.count_if(c >= least).alias("confident"), F.count("*").alias("n"))


# ---- diagnostics stores ---------------------------------------------------------------------------------------------


def save_run(runs: DataFrame, findings: DataFrame, run: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(runs, findings) after a run is saved with its findings; a run of the same analysis id takes the old one's place."""
    ids = run.select("analysis_id").distinct()
    keep = lambda df: df.join(ids, "analysis_id", "left_anti")
    return keep(runs).unionByName(run), keep(findings).unionByName(found.join(ids, "analysis_id", "left_semi"))


def delete_project(runs: DataFrame, findings: DataFrame, project) -> tuple[DataFrame, DataFrame]:
    """(runs, findings) without a project's runs and their findings."""
    gone = runs.filter(F.col("project") == project).select("analysis_id")
    return runs.filter(~F.col("project").eqNullSafe(F.lit(project))), findings.join(gone, "analysis_id", "left_anti")


def list_runs(runs: DataFrame, limit: int = 50, **equal) -> DataFrame:
    for name, v in equal.items():
        if v is not None:
            runs = runs.filter(F.col(name) == v)
    return runs.orderBy(F.desc("created_at"), F.desc("run_id")).limit(limit)


def compare_latest(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """(tool, total, files, overlap_files, severities) over the latest run of each tool; the severities as sorted text."""
    latest = latest_runs(runs, "tool").select("analysis_id", "tool")
    f = findings.drop("tool").join(latest, "analysis_id")
    busy = f.groupBy("file_path").agg(F.count("*").alias("n")).filter("n > 1").select("file_path", F.lit(1).alias("busy"))
    per = f.groupBy("tool", "file_path").agg(F.count("*").alias("n")).join(busy, "file_path", "left")
    totals = per.groupBy("tool").agg(F.sum("n").alias("total"), F.count("*").alias("files"), F.count("busy").alias("overlap_files"))
    severity = f.groupBy("tool", "severity").agg(F.count("*").alias("n"))
    severity = severity.groupBy("tool").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "severity", "n"))), ",").alias("severities"))
    return totals.join(severity, "tool")


def attribution_totals(findings: DataFrame) -> DataFrame:
    s = F.col("symbol_id").isNull()
    return findings.agg(F.count_if(~s).alias("attributed"), F.count_if(s).alias("unattributed"), F.count("*").alias("total"))


def with_properties(findings: DataFrame, schema: str, column: str = "properties") -> DataFrame:
    """Findings with the fields of their JSON properties as columns; unreadable JSON gives nulls."""
    rest = [c for c in findings.columns if c != column]
    return findings.select(*rest, F.from_json(column, schema).alias("_p")).select(*rest, "_p.*")


# ---- manifests and history ------------------------------------------------------------------------------------------


def verify_manifest(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(path, status): added, removed, changed or unchanged, by the hashes of path and content."""
    m, f = manifest.select("path", F.col("sha256").alias("a")), files.select("path", F.col("sha256").alias("b"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") == F.col("b"), "unchanged").otherwise("changed")
    return m.join(f, "path", "full_outer").select("path", status.alias("status"))


def parents(commits: DataFrame, links: DataFrame) -> DataFrame:
    """Commits with the sorted hashes of their parents, an empty list without any; a commit has a handful of parents."""
    p = links.groupBy("hash").agg(F.array_sort(F.collect_set("parent")).alias("parents"))
    return commits.join(p, "hash", "left").withColumn("parents", F.coalesce("parents", F.array().cast("array<string>")))


def files_at(snapshots: DataFrame, tree: str | None = None) -> DataFrame:
    """(path, sha256) of the files of a tree hash; without one, of the newest (at)."""
    if tree is None:
        last = snapshots.agg(F.max(F.struct("at", "tree")).alias("r")).select("r.tree")
        return snapshots.join(F.broadcast(last), "tree", "left_semi").select("path", "sha256")  # one row
    return snapshots.filter(F.col("tree") == tree).select("path", "sha256")


def propagate(learned: DataFrame, matches: DataFrame, least: float = 0.5) -> DataFrame:
    """Learnings (key, value, project, tags) as knowledge of the projects that match them (key, target, score).

    (project, title, solution, tags): only tagged ones, with the source's tag added; the best match of a pair counts once.
    """
    best = matches.groupBy("key", "target").agg(F.max("score").alias("score")).filter(F.col("score") >= least)
    rows = learned.filter(F.size("tags") > 0).join(best, "key").filter("target <> project")
    tags = F.concat("tags", F.array(F.concat(F.lit("propagated-from:"), "project"), F.lit("cross-project")))
    return rows.select(F.col("target").alias("project"), F.concat(F.lit("[Propagated] "), "key").alias("title"), F.col("value").alias("solution"), tags.alias("tags"))


# ---- evaluation -----------------------------------------------------------------------------------------------------


def eval_summary(results: DataFrame, metrics: list[str]) -> DataFrame:
    """(run, query_type, n, mean of each metric, p95_ms): by query type and, with a null type, overall."""
    means = [F.avg(m).alias(m) for m in metrics]
    sets = results.groupingSets([[F.col("run"), F.col("query_type")], [F.col("run")]], "run", "query_type")
    return sets.agg(F.count("*").alias("n"), *means, F.percentile("latency_ms", 0.95).alias("p95_ms"))


def run_deltas(summary: DataFrame, metrics: list[str]) -> DataFrame:
    """Each run's metrics less those of the run before, by query type; null for the first."""
    w = Window.partitionBy("query_type").orderBy("run")
    return summary.withColumns({f"{m}_delta": F.col(m) - F.lag(m).over(w) for m in metrics})


def register_files(queue: DataFrame, files: DataFrame, now_ms: int) -> DataFrame:
    """The queue with new files as pending rows; known ids stay as they are."""
    new = files.join(queue.select("id"), "id", "left_anti").select("id", F.lit("pending").alias("status"), F.lit(now_ms).alias("created_ms"), F.lit(None).cast("bigint").alias("started_ms"))
    return queue.select("id", "status", "created_ms", "started_ms").unionByName(new)


def mark(queue: DataFrame, ids: DataFrame, status: str, now_ms: int) -> DataFrame:
    """The queue with some rows in a status; those that begin to be processed take the time."""
    hit = queue.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    begun = F.when(F.col("_hit") & F.lit(status == "processing"), F.lit(now_ms)).otherwise(F.col("started_ms"))
    return hit.withColumns({"started_ms": begun, "status": F.when(F.col("_hit"), status).otherwise(F.col("status"))}).drop("_hit")


def insights(memories: DataFrame, category: str | None = None, limit: int = 20) -> DataFrame:
    """Derived insights, newest first."""
    if category is not None:
        memories = memories.filter(F.col("category") == category)
    return memories.orderBy(F.desc("created_ms"), "key").limit(limit)


def stale_insights(derived: DataFrame, live: DataFrame) -> DataFrame:
    """Insights (key, source) of which a source no longer lives; each once."""
    return derived.join(live.select(F.col("key").alias("source")).distinct(), "source", "left_anti").select("key").distinct()


def code_matches(chunks: DataFrame, term: str, limit: int = 10) -> DataFrame:
    """Chunks (path, start_line, end_line, content) that hold a term: by score, then place of the match, span, line."""
    low = F.lower("content")
    at = F.instr(low, term.lower())
    n = (F.length(low) - F.length(F.replace(low, F.lit(term.lower()), F.lit("")))) / len(term)
    span = F.col("end_line") - F.col("start_line")
    hits = chunks.withColumns({"score": n.cast("bigint"), "match_at": at, "span": span}).filter("match_at > 0")
    return hits.orderBy(F.desc("score"), "match_at", "span", "start_line", "path").limit(limit).select("path", "start_line", "score", "match_at", "span")


def ingest_report(stages: dict[str, Column], rows: DataFrame) -> DataFrame:
    """(stage, status, n): the events of an ingestion run, start and complete, with what each stage has, from one pass."""
    counted = rows.agg(*(c.alias(n) for n, c in stages.items()))
    done = [F.struct(F.lit(n).alias("stage"), F.lit("complete").alias("status"), F.col(n).cast("bigint").alias("n")) for n in stages]
    start = F.struct(F.lit("run").alias("stage"), F.lit("start").alias("status"), F.lit(None).cast("bigint").alias("n"))
    return counted.select(F.explode(F.array(start, *done)).alias("r")).select("r.*")
