"""Queries over versioned tables: what a store holds after commits that were taken, refused or cut off."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import commits as cm
from engram.operators import digests as dg
from engram.operators import index as ix
from engram.operators import scoring as sc
from engram.operators import search as se
from engram.operators import segments as sg
from engram.plans.log import _LOG, NOW_MS
from engram.plans.network import _findings, _runs
from engram.plans.retrieval import _CASE, _CATS, _TOK, _bm25_sql
from engram.plans.structure import _FIND
from engram.registry import query
from engram.session import new_path
from engram.sources.store import Store
from engram.sources.tables import events, table


def _store(spark) -> Store:
    return Store(spark, new_path(spark, "store"))


def _log(spark, sf):
    return events(spark, sf).select("event_id", "ms", "session_id", "event_type", "key", "value", F.lit(None).cast("bigint").alias("other"), F.lit(None).cast("string").alias("reason"))


@query("append_batches", _LOG + "SELECT event_id, ms, event_type, key FROM log WHERE event_id % 4 < 3")
def append_batches(spark, sf):
    """A first batch and a good one are there; one with known ids, one with ids that stand twice and one cut off are not."""
    store, log = _store(spark), _log(spark, sf)
    cm.append_batch(store, log.filter("event_id % 4 < 2"))
    for bad in (log.filter("event_id % 4 in (1, 3)"), log.filter("event_id % 4 = 3").unionByName(log.filter("event_id % 8 = 7"))):
        try:
            cm.append_batch(store, bad)
        except cm.Rejected:
            continue
        raise AssertionError("a batch with known or repeated ids was taken")
    store.stage(log.filter("event_id % 4 = 3"))  # a writer that dies before its commit
    cm.append_batch(store, log.filter("event_id % 4 = 2"))
    store.clean()
    return Store(spark, store.path).at().table("events").select("event_id", "ms", "event_type", "key")


@query("created_ids", """WITH e AS (SELECT event_id, epoch_us(ts) // 60000000 AS ms, row_number() OVER (PARTITION BY epoch_us(ts) // 60000000 ORDER BY event_id) - 1 AS seq FROM events),
  h AS (SELECT event_id, seq, lpad(lower(to_hex(ms + seq // 4096)), 12, '0') AS h, sha256(CAST(event_id AS VARCHAR)) AS s FROM e)
  SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-7' || lpad(lower(to_hex(seq % 4096)), 3, '0') || '-8' || substr(s, 1, 3) || '-' || substr(s, 4, 12) AS id FROM h""")
def created_ids(spark, sf):
    """Ids that rise with the events of one tick, here a minute, so that ticks have many."""
    log = events(spark, sf).select("event_id", F.floor(F.col("ms") / 60_000).alias("ms"))
    return cm.with_ids(log, "event_id").select("event_id", "id")


@query("save_run_commits", _FIND + "SELECT analysis_id, count(*) AS n FROM f WHERE analysis_id <> 2 GROUP BY 1 UNION ALL SELECT 2, count(*) FROM f WHERE analysis_id = 3")
def save_run_commits(spark, sf):
    """Runs and findings commit together; a second run of analysis 2 takes the first one's place."""
    store = _store(spark)
    runs, found = _runs(spark, sf), _findings(spark, sf).withColumn("run_id", F.col("analysis_id"))
    cm.save_run(store, runs, found)
    again = runs.filter("analysis_id = 2").withColumns({"run_id": F.lit(-2).cast("bigint"), "created_at": F.col("created_at") + 1})
    cm.save_run(store, again, found.filter("analysis_id = 3").withColumns({"analysis_id": F.lit(2).cast("bigint"), "run_id": F.lit(-2).cast("bigint")}))
    return cm.current_findings(store.at()).groupBy("analysis_id").agg(F.count("*").alias("n"))


@query("manifest_versions", "SELECT p_brand AS path, count(*) AS bytes, md5(CAST(sum(p_partkey) AS VARCHAR)) AS sha256 FROM part WHERE p_size > 10 GROUP BY 1")
def manifest_versions(spark, sf):
    """A project's manifest as last saved, by way of two versions and another project's."""
    store, part = _store(spark), table(spark, sf, "part")
    files = lambda df: df.groupBy(F.col("p_brand").alias("path")).agg(F.count("*").alias("bytes"), F.md5(F.sum("p_partkey").cast("string")).alias("sha256"))
    for name, df in (("a", part), ("b", part.filter("p_size < 5")), ("a", part.filter("p_size > 10"))):
        cm.save_manifest(store, name, files(df))
    return cm.load_manifest(store.at(), "a").select("path", "bytes", "sha256")


@query("corpus_hashes", "SELECT source, sha256(string_agg(x, '' ORDER BY x)) AS corpus_hash, max(doc_id) > 150 AS stale FROM (SELECT source, doc_id, 'd' || doc_id || chr(9) || sha256(text) || chr(10) AS x FROM documents) GROUP BY source")
def corpus_hashes(spark, sf):
    """Each source's corpus hash, and whether an answer from its first 150 documents is stale."""
    files = table(spark, sf, "documents").select("source", F.concat(F.lit("d"), "doc_id").alias("path"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"), "doc_id")
    then = dg.corpus_hash(files.filter("doc_id <= 150"), "source").withColumnRenamed("corpus_hash", "then")
    now = dg.corpus_hash(files, "source").join(then, "source", "left")
    return now.select("source", "corpus_hash", (~F.col("corpus_hash").eqNullSafe(F.col("then"))).alias("stale"))


def _pick(xs, n):
    return F.element_at(F.array(*map(F.lit, xs)), (F.col("memory_id") % n + 1).cast("int"))


def _relevance(spark, sf):
    """A row for each save: read as often as its key was recalled in its session."""
    log = events(spark, sf)
    reads = log.filter("event_type = 'MEMORY_RECALLED'").groupBy("session_id", "key").agg(F.count("*").alias("reads"), F.max("ms").alias("last_read"))
    m = log.filter("event_type = 'MEMORY_SAVED'").select(F.col("event_id").alias("memory_id"), "session_id", "key", "ms").join(reads, ["session_id", "key"], "left")
    m = m.withColumns({"priority": _pick(["high", "normal", "low"], 3), "category": _pick(_CATS, len(_CATS)), "accesses": F.coalesce("reads", F.lit(0)), "last_ms": F.greatest("ms", "last_read")})
    score = sc.relevance(F.col("priority"), F.col("category"), F.col("accesses"), (F.lit(NOW_MS) - F.col("last_ms")) / cm.DAY_MS)
    return m.select("memory_id", "priority", "category", "accesses", "last_ms", score.alias("score"))


_SCORE = f"""{_CASE(sc.PRIORITY, "priority", 1)} * {_CASE(sc.CATEGORY, "category", 1)} * CASE WHEN accesses > 0 THEN least(1 + log2(accesses::DOUBLE) * 0.1, 2.0) ELSE 1.0 END
  * pow(1 + (19.0::DOUBLE / 81) * days / {_CASE(sc.STABILITY_DAYS, "category", 30)}, -0.5) * (1 + 0.3 * ln(1.0 + accesses) * exp(-days * 24 / 168))"""
_CYCLE = (
    _LOG
    + f""", reads AS (SELECT session_id, key, count(*) AS reads, max(ms) AS last_read FROM log WHERE event_type = 'MEMORY_RECALLED' GROUP BY 1, 2),
  m AS (SELECT event_id AS memory_id, log.key, ['high', 'normal', 'low'][event_id % 3 + 1] AS priority, [{", ".join(f"'{c}'" for c in _CATS)}][event_id % {len(_CATS)} + 1] AS category, coalesce(reads, 0) AS accesses,
    ({NOW_MS + 20 * cm.DAY_MS} - greatest(ms, last_read)) / 86400000.0::DOUBLE AS days, ({NOW_MS} - greatest(ms, last_read)) / 86400000.0::DOUBLE AS days0 FROM log LEFT JOIN reads ON reads.key = log.key AND reads.session_id = log.session_id WHERE event_type = 'MEMORY_SAVED'),
  s0 AS (SELECT *, {_SCORE.replace("days", "days0")} AS score0, {_SCORE} AS score FROM m), dd AS (SELECT memory_id FROM (SELECT memory_id, key, max(memory_id) OVER (PARTITION BY key) AS newest FROM m WHERE key IS NOT NULL) WHERE memory_id < newest),
  l AS (SELECT * FROM s0 WHERE memory_id NOT IN (FROM dd)), st AS (SELECT memory_id, category FROM l WHERE score0 < 0.6 AND days >= 25 ORDER BY score0, memory_id LIMIT 1000),
  pr AS (SELECT memory_id FROM l WHERE score0 < 1.0 AND accesses = 0 AND days > 22 AND memory_id NOT IN (SELECT memory_id FROM st) ORDER BY memory_id LIMIT 500), rs AS (SELECT * FROM l WHERE memory_id NOT IN (SELECT memory_id FROM st) AND memory_id NOT IN (FROM pr)),
  ex AS (SELECT count(*) AS n FROM log WHERE ms < {NOW_MS + 20 * cm.DAY_MS} - CASE WHEN event_type = 'MEMORY_RECALLED' THEN 10 ELSE 40 END * 86400000::BIGINT)
  SELECT 'dedup' AS part, (SELECT count(*) FROM dd) AS n, 0.0::DOUBLE AS x UNION ALL SELECT 'consolidate', (SELECT count(*) FROM st), 0.0 UNION ALL SELECT 'digests', (SELECT coalesce(sum((c + 19) // 20), 0)::BIGINT FROM (SELECT count(*) AS c FROM st GROUP BY category)), 0.0
  UNION ALL SELECT 'prune', (SELECT count(*) FROM pr), 0.0 UNION ALL SELECT 'retention', (SELECT n FROM ex), 0.0 UNION ALL SELECT 'rescore', (SELECT count(*) FROM rs), 0.0
  UNION ALL SELECT 'events', (SELECT count(*) FROM log) - (SELECT n FROM ex) + (SELECT count(*) FROM dd) + (SELECT count(*) FROM st) + (SELECT count(*) FROM pr), 0.0 UNION ALL SELECT 'relevance', (SELECT count(*) FROM rs), (SELECT round(coalesce(sum(score), 0), 4) FROM rs)"""
)


@query("maintenance_commit", _CYCLE)
def maintenance_commit(spark, sf):
    """What a maintenance cycle has left in its version, read by a second reader after a cut-off cycle before it."""
    store = _store(spark)
    store.commit(append={"events": _log(spark, sf), "relevance": _relevance(spark, sf)})
    store.stage(_log(spark, sf).limit(0))
    cm.maintain(store, NOW_MS + 20 * cm.DAY_MS, 40, 0.6, 25, 1.0, 22)
    now = Store(spark, store.path).at()
    rows = now.table("cycles").select(F.col("step").alias("part"), "n", F.lit(0.0).alias("x"))
    rows = rows.unionByName(now.table("events").agg(F.lit("events").alias("part"), F.count("*").alias("n"), F.lit(0.0).alias("x")))
    return rows.unionByName(now.table("relevance").agg(F.lit("relevance").alias("part"), F.count("*").alias("n"), F.round(F.coalesce(F.sum("score"), F.lit(0.0)), 4).alias("x")))


@query("prune_candidates", _CYCLE[: _CYCLE.index(", dd AS")] + " SELECT memory_id, accesses FROM s0 WHERE score0 < 0.9 AND accesses = 0 AND days > 29 ORDER BY memory_id LIMIT 500")
def prune_candidates(spark, sf):
    """Saves whose key was never read, of a low score and old; the first 500."""
    rel = _relevance(spark, sf).withColumn("days", (F.lit(NOW_MS + 20 * cm.DAY_MS) - F.col("last_ms")) / cm.DAY_MS)
    return sc.prunable(rel, 0.9, 29).select("memory_id", "accesses")


# ---- segments -------------------------------------------------------------------------------------------------------

_CHANGED = """(SELECT doc_id, CASE WHEN doc_id % 11 = 3 THEN 'thing again' WHEN doc_id % 5 = 0 THEN 'new words here thing' ELSE text END AS text, lang, source FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 11 = 3)"""


def _segmented(spark, sf) -> sg.Segments:
    """Documents, then updates that change some, take some out and bring some of these back, merged on the way."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    index = sg.create(_store(spark), d.filter("doc_id % 3 < 2"), "doc_id").update(d.filter("doc_id % 3 = 2"))
    index.update(d.filter("doc_id % 5 = 0").withColumn("text", F.lit("new words here thing")))
    index.update(gone=d.filter("doc_id % 7 = 0").select(F.col("doc_id").alias("id"))).merge()
    return index.update(d.filter("doc_id % 11 = 3").withColumn("text", F.lit("thing again"))).merge(2)


@query("index_segments", f"SELECT term, count(*) AS df, CAST(sum(tf) AS DOUBLE) AS tf FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK.format(n=1)}) AS term FROM {_CHANGED}) GROUP BY 1, 2) GROUP BY term")
def index_segments(spark, sf):
    """Frequencies of an index that was made in five segments and merged, as of one made at once."""
    return sg.frequencies(_segmented(spark, sf))


@query("segments_bm25", _bm25_sql({"thing": 1, "the": 1}).replace("FROM documents)", f"FROM {_CHANGED})") + "SELECT doc_id, round(score, 6) AS score FROM bm ORDER BY score DESC, doc_id LIMIT 50")
def segments_bm25(spark, sf):
    return se.top(ix.bm25(spark, _segmented(spark, sf), "thing the"), 50).select("doc_id", F.round("score", 6).alias("score"))
