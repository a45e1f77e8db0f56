"""Queries over the event log and the memories folded from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import events as ev
from engram.operators import memory as mem
from engram.registry import query
from engram.sources.tables import events, table

_LOG = """WITH log AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id AS session_id,
  CASE event_type WHEN 'purchase' THEN 'MEMORY_SAVED' WHEN 'click' THEN 'MEMORY_UPDATED' WHEN 'error' THEN 'MEMORY_DELETED'
    WHEN 'view' THEN 'MEMORY_RECALLED' WHEN 'signup' THEN 'SESSION_STARTED' END AS event_type,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS key, value FROM events)
"""
#: The moment that stands for now in these queries: the end of January 2024.
NOW_MS = 1_706_745_600_000


@query("event_by_id", _LOG + "SELECT event_id, ms, session_id, event_type FROM log WHERE event_id = 4242")
def event_by_id(spark, sf):
    return ev.by_id(events(spark, sf), 4242).select("event_id", "ms", "session_id", "event_type")


@query("events_by_session", _LOG + "SELECT event_id, ms, event_type FROM log WHERE session_id = 17")
def events_by_session(spark, sf):
    return ev.by_session(events(spark, sf), 17).select("event_id", "ms", "event_type")


@query("events_in_range", _LOG + "SELECT event_id, ms, session_id FROM log WHERE ms BETWEEN 1704844800000 AND 1704931200000")
def events_in_range(spark, sf):
    return ev.in_range(events(spark, sf), 1_704_844_800_000, 1_704_931_200_000).select("event_id", "ms", "session_id")


@query("recent_events", _LOG + "SELECT event_id, ms, event_type FROM log ORDER BY ms DESC, event_id DESC LIMIT 20")
def recent_events(spark, sf):
    return ev.recent(events(spark, sf), 20).select("event_id", "ms", "event_type")


@query("sessions_by_metadata", _LOG + "SELECT DISTINCT session_id FROM log WHERE event_type = 'SESSION_STARTED' AND key = 7")
def sessions_by_metadata(spark, sf):
    return ev.sessions_with(events(spark, sf), F.col("key") == 7)


@query("optional_filter", _LOG + "SELECT event_id, session_id FROM log WHERE event_type = 'MEMORY_SAVED' AND session_id = 5")
def optional_filter(spark, sf):
    return ev.optional_filters(events(spark, sf), event_type="MEMORY_SAVED", session_id=5, key=None).select("event_id", "session_id")


@query("log_stats", _LOG + "SELECT count(*) AS event_count, count(DISTINCT session_id) AS session_count FROM log")
def log_stats(spark, sf):
    return ev.stats(events(spark, sf))


@query("sessions_by_first_seen", _LOG + "SELECT session_id, min(ms) AS first_ms FROM log GROUP BY session_id")
def sessions_by_first_seen(spark, sf):
    return ev.sessions_by_first_seen(events(spark, sf))


@query("events_page", _LOG + "SELECT event_id, ms, event_type, (SELECT count(*) FROM log) AS total FROM log ORDER BY ms DESC, event_id DESC LIMIT 25 OFFSET 50")
def events_page(spark, sf):
    return ev.page(events(spark, sf), 25, 50).select("event_id", "ms", "event_type", "total")


@query("worklog_tail", _LOG + "SELECT event_id, ms, event_type FROM (SELECT * FROM log WHERE event_type IN ('MEMORY_SAVED', 'MEMORY_UPDATED', 'SESSION_STARTED') ORDER BY ms DESC, event_id DESC LIMIT 30)")
def worklog_tail(spark, sf):
    return ev.tail(events(spark, sf), ["MEMORY_SAVED", "MEMORY_UPDATED", "SESSION_STARTED"], 30).select("event_id", "ms", "event_type")


@query("retention_prune", _LOG + f"""SELECT event_type, count(*) AS kept FROM log
  WHERE ms >= CASE WHEN event_type = 'MEMORY_RECALLED' THEN {NOW_MS} - 3 * 86400000 ELSE {NOW_MS} - 14 * 86400000 END GROUP BY event_type""")
def retention_prune(spark, sf):
    return ev.retained(events(spark, sf), NOW_MS, 14, noisy="MEMORY_RECALLED").groupBy("event_type").agg(F.count("*").alias("kept"))


@query("session_checkpoints", _LOG + "SELECT session_id, max(event_id) AS last_event_id, count(*) AS event_count FROM log GROUP BY session_id")
def session_checkpoints(spark, sf):
    return ev.checkpoints(events(spark, sf))


_LIVE = """, live AS (SELECT key, max(event_id) AS event_id FROM log s WHERE event_type = 'MEMORY_SAVED' AND NOT EXISTS
  (SELECT 1 FROM log d WHERE d.event_type = 'MEMORY_DELETED' AND d.key = s.key AND d.event_id > s.event_id) GROUP BY key)
"""


@query("checkpoint_items", _LOG + _LIVE + """SELECT c.session_id, c.last_event_id, s.key FROM live JOIN log s USING (event_id)
  JOIN (SELECT session_id, max(event_id) AS last_event_id FROM log GROUP BY session_id) c ON c.session_id = s.session_id""")
def checkpoint_items(spark, sf):
    log = events(spark, sf)
    return ev.checkpoint_items(mem.live(log), ev.checkpoints(log))


@query("delete_sessions_cascade", _LOG + "SELECT session_id, count(*) AS n FROM log WHERE session_id NOT IN (SELECT session_id FROM log WHERE key = 3) GROUP BY session_id")
def delete_sessions_cascade(spark, sf):
    log = events(spark, sf)
    return ev.delete_sessions(log, log.filter("key = 3")).groupBy("session_id").agg(F.count("*").alias("n"))


@query("session_summary", _LOG + f"""SELECT session_id, min(CASE WHEN event_type = 'SESSION_STARTED' THEN ms END) AS started_ms, max(ms) AS last_ms, count(*) AS event_count,
  CAST(count(*) FILTER (WHERE event_type = 'MEMORY_SAVED') AS BIGINT) AS saves, CASE WHEN max(ms) < {NOW_MS} - 3600000 THEN 'expired' ELSE 'active' END AS status
  FROM log GROUP BY session_id HAVING count(*) FILTER (WHERE event_type = 'SESSION_STARTED') > 0""")
def session_summary(spark, sf):
    return ev.sessions(events(spark, sf), NOW_MS)


@query("session_windows", _LOG + """SELECT session_id, CAST(run AS BIGINT) AS run, min(ms) AS start_ms, max(ms) AS end_ms, count(*) AS n FROM (
  SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY ms, event_id) AS run FROM (
  SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY session_id ORDER BY ms, event_id) < 21600000 THEN 0 ELSE 1 END AS new FROM log)) GROUP BY 1, 2""")
def session_windows(spark, sf):
    return ev.idle_sessions(events(spark, sf), 21_600_000)


@query("causality_chain", _LOG.replace("WITH log", "WITH RECURSIVE log") + """, c AS (SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id > 0 THEN event_id // 3 END AS caused_by FROM log),
  r AS (SELECT event_id, caused_by AS ancestor, 1 AS hops FROM c WHERE caused_by IS NOT NULL
  UNION ALL SELECT r.event_id, c.caused_by, r.hops + 1 FROM r JOIN c ON c.event_id = r.ancestor WHERE c.caused_by IS NOT NULL AND r.hops < 10)
  SELECT * FROM r""")
def causality_chain(spark, sf):
    log = events(spark, sf).withColumn("caused_by", F.expr("CASE WHEN event_id % 3 = 0 AND event_id > 0 THEN event_id div 3 END"))
    return ev.causality_chain(log)


@query("live_memories_antijoin", _LOG + _LIVE + "SELECT key, event_id, s.session_id, s.ms, s.value FROM live JOIN log s USING (event_id, key)")
def live_memories(spark, sf):
    return mem.live(events(spark, sf))


@query("latest_per_key", _LOG + "SELECT key, event_id, ms, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, event_id DESC) AS r FROM log WHERE event_type = 'MEMORY_SAVED') WHERE r = 1")
def latest_per_key(spark, sf):
    saves = events(spark, sf).filter("event_type = 'MEMORY_SAVED'").select("key", "ms", "event_id", "value")
    return mem.latest_per(saves, "key", order=("ms", "event_id")).select("key", "event_id", "ms", "value")


@query("hydrate_memories", _LOG + """, s AS (SELECT session_id, key, max(event_id) FILTER (WHERE event_type = 'MEMORY_SAVED') AS memory_id,
  max(event_id) FILTER (WHERE event_type = 'MEMORY_DELETED') AS gone FROM log GROUP BY 1, 2),
  k AS (SELECT s.session_id, s.key, memory_id, l.ms AS created_ms, l.value AS saved FROM s JOIN log l ON l.event_id = memory_id WHERE gone IS NULL OR gone < memory_id),
  u AS (SELECT k.session_id, k.key, max_by(l.ms, l.event_id) AS ms, max_by(l.value, l.event_id) AS value, count(*) AS n
  FROM k JOIN log l ON l.session_id = k.session_id AND l.key = k.key AND l.event_type = 'MEMORY_UPDATED' AND l.event_id > k.memory_id GROUP BY 1, 2)
  SELECT k.session_id, k.key, memory_id, created_ms, coalesce(u.ms, created_ms) AS updated_ms, coalesce(u.value, saved) AS value, coalesce(n, 0) AS updates
  FROM k LEFT JOIN u USING (session_id, key)""")
def hydrate_memories(spark, sf):
    return mem.hydrate(events(spark, sf))


@query("dedup_supersede", _LOG + """SELECT key, event_id, superseded_by FROM (SELECT key, event_id, max(event_id) OVER (PARTITION BY key) AS superseded_by
  FROM log WHERE event_type = 'MEMORY_SAVED') WHERE event_id < superseded_by""")
def dedup_supersede(spark, sf):
    return mem.supersedes(events(spark, sf))


@query("duplicate_keys_having", _LOG + "SELECT key, count(*) AS n FROM log WHERE event_type = 'MEMORY_SAVED' GROUP BY key HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    return mem.duplicate_keys(events(spark, sf))


@query("cross_session_memories", _LOG + """SELECT event_id, session_id, key, ms FROM log s WHERE event_type = 'MEMORY_SAVED' AND session_id <> 5 AND NOT EXISTS
  (SELECT 1 FROM log d WHERE d.event_type = 'MEMORY_DELETED' AND d.key = s.key AND d.event_id > s.event_id) ORDER BY ms DESC, event_id DESC LIMIT 500""")
def cross_session_memories(spark, sf):
    return mem.cross_session(events(spark, sf), 5).select("event_id", "session_id", "key", "ms")


@query("unresolved_conflicts", _LOG + "SELECT event_id, session_id, key FROM log s WHERE event_type = 'MEMORY_UPDATED' AND NOT EXISTS (SELECT 1 FROM log d WHERE d.event_type = 'SESSION_STARTED' AND d.value < 2 AND d.session_id = s.session_id)")
def unresolved_conflicts(spark, sf):
    log = events(spark, sf)
    found = mem.unresolved(log.filter("event_type = 'MEMORY_UPDATED'"), log.filter("event_type = 'SESSION_STARTED' and value < 2"), on="session_id")
    return found.select("event_id", "session_id", "key")


@query("recall_glob", "SELECT CAST(doc_id AS BIGINT) AS doc_id, key FROM (SELECT doc_id, source || '/' || doc_id AS key, lang, n_chars FROM documents) WHERE regexp_matches(key, '^src1.*/.9.*$') AND lang = 'en' ORDER BY n_chars DESC, key LIMIT 100")
def recall_glob(spark, sf):
    memories = table(spark, sf, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("key"), "lang", "n_chars")
    return mem.recall(memories, pattern="src1*/?9*", sort="n_chars", lang="en").select("doc_id", "key")


@query("like_search", r"SELECT doc_id FROM documents WHERE text ILIKE '%the%' AND source ILIKE '%SRC\_1%' ESCAPE '\' OR text ILIKE '%licensed under%'")
def like_search(spark, sf):
    d = table(spark, sf, "documents")
    hit = mem.like_contains(F.col("text"), "the") & mem.like_contains(F.col("source"), "SRC_1") | mem.like_contains(F.col("text"), "licensed under")
    return d.filter(hit).select("doc_id")


@query("agent_visibility", """SELECT event_id, CASE WHEN scope IS NULL OR scope = 'public' THEN true WHEN owner = 'agent1' THEN true WHEN scope = 'shared' THEN true
  WHEN scope = 'role' THEN owner_role = 'role2' ELSE false END AS visible FROM (SELECT event_id, 'agent' || (user_id % 5) AS owner, 'role' || (user_id % 3) AS owner_role,
  CASE event_id % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'private' WHEN 2 THEN 'shared' WHEN 3 THEN 'role' END AS scope FROM events)""")
def agent_visibility(spark, sf):
    e = events(spark, sf).select(
        "event_id",
        F.concat(F.lit("agent"), F.col("session_id") % 5).alias("owner"),
        F.concat(F.lit("role"), F.col("session_id") % 3).alias("owner_role"),
        F.element_at(F.array(*(F.lit(x) for x in ("public", "private", "shared", "role", None))), (F.col("event_id") % 5 + 1).cast("int")).alias("scope"),
    )
    return e.select("event_id", mem.visible(F.col("owner"), F.col("scope"), F.col("owner_role"), F.lit("agent1"), F.lit("role2")).alias("visible"))


@query("memory_stats_grouping_sets", """SELECT 'total' AS dimension, '' AS value, count(*) AS n FROM documents UNION ALL SELECT 'lang', lang, count(*) FROM documents GROUP BY lang
  UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source""")
def memory_stats(spark, sf):
    return mem.dimension_counts(table(spark, sf, "documents"), "lang", "source")


@query("distinct_keys", _LOG + "SELECT count(DISTINCT key) AS n FROM log WHERE event_type = 'MEMORY_SAVED'")
def distinct_keys(spark, sf):
    return events(spark, sf).filter("event_type = 'MEMORY_SAVED'").agg(F.count_distinct("key").alias("n"))


@query("session_event_counts", _LOG + "SELECT session_id, count(*) AS events, CAST(count(*) FILTER (WHERE event_type = 'MEMORY_SAVED') AS BIGINT) AS saves FROM log GROUP BY session_id")
def session_event_counts(spark, sf):
    return events(spark, sf).groupBy("session_id").agg(F.count("*").alias("events"), F.count_if(F.col("event_type") == "MEMORY_SAVED").alias("saves"))


@query("merge_ordered_union", "SELECT doc_id, CAST(min(source_rank) AS INTEGER) AS source_rank FROM (SELECT doc_id, 0 AS source_rank FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, 1 FROM documents WHERE n_chars > 4000) GROUP BY doc_id")
def merge_ordered_union(spark, sf):
    d = table(spark, sf, "documents")
    return mem.merge_first(d.filter("lang = 'fr'"), d.filter("n_chars > 4000"), key="doc_id", keep=[])


@query("merge_max_score", "SELECT doc_id, max(score) AS score FROM (SELECT doc_id, n_chars * 0.5::DOUBLE AS score FROM documents WHERE lang = 'fr' UNION ALL SELECT doc_id, n_chars * 1.0::DOUBLE FROM documents WHERE n_chars > 4000) GROUP BY doc_id")
def merge_max_score(spark, sf):
    d = table(spark, sf, "documents")
    return mem.merge_max(d.filter("lang = 'fr'").select("doc_id", (F.col("n_chars") * 0.5).alias("score")), d.filter("n_chars > 4000").select("doc_id", (F.col("n_chars") * 1.0).alias("score")), key="doc_id")
