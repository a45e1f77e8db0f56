"""Queries over memory writes, session lifecycle, maintenance and recall."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import events as ev
from engram.operators import lifecycle as lc
from engram.operators import memory as mem
from engram.operators import search as se
from engram.operators import state as st
from engram.plans.log import _LIVE, _LOG, NOW_MS
from engram.plans.structure import _fold
from engram.registry import query
from engram.sources.tables import events, table

_PARTS = """, c AS (SELECT *, CASE WHEN event_type = 'MEMORY_SAVED' OR event_id % 3 = 0 THEN value END AS v, CASE WHEN event_id % 4 = 1 THEN 'high' WHEN event_type = 'MEMORY_SAVED' THEN 'normal' END AS priority,
  'm' || event_id % 3 AS mk, event_id % 7 AS mv FROM log),
  ends AS (SELECT session_id, key, max(event_id) FILTER (WHERE event_type = 'MEMORY_SAVED') AS memory_id, max(event_id) FILTER (WHERE event_type = 'MEMORY_DELETED') AS gone FROM log GROUP BY 1, 2),
  s AS (SELECT c.*, memory_id FROM c JOIN ends USING (session_id, key) WHERE (gone IS NULL OR gone < memory_id) AND event_id >= memory_id AND event_type IN ('MEMORY_SAVED', 'MEMORY_UPDATED')),
  f AS (SELECT session_id, key, memory_id, max_by(v, event_id) FILTER (WHERE v IS NOT NULL) AS v, max_by(priority, event_id) FILTER (WHERE priority IS NOT NULL) AS priority, max(event_id) AS last_event_id FROM s GROUP BY 1, 2, 3),
  m AS (SELECT session_id, key, string_agg(mk || '=' || mv, ';' ORDER BY mk) AS metadata FROM (SELECT session_id, key, mk, max_by(mv, event_id) AS mv FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2)
"""


@query("hydrate_partial_updates", _LOG + _PARTS + "SELECT session_id, key, memory_id, v, priority, last_event_id, metadata FROM f JOIN m USING (session_id, key)")
def hydrate_partial_updates(spark, sf):
    log, saved = events(spark, sf), F.col("event_type") == "MEMORY_SAVED"
    entry = F.create_map(F.concat(F.lit("m"), F.col("event_id") % 3), F.col("event_id") % 7)
    changes = log.select("event_id", "session_id", "key", "event_type", F.when(saved | (F.col("event_id") % 3 == 0), F.col("value")).alias("v"), F.when(F.col("event_id") % 4 == 1, "high").when(saved, "normal").alias("priority"), entry.alias("metadata"))
    pairs = F.transform(F.map_entries("metadata"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return lc.hydrate_partial(changes, ["v", "priority"]).withColumn("metadata", F.array_join(F.sort_array(pairs), ";"))


@query("plan_writes", _LOG + _LIVE + """, r AS (SELECT event_id, key, CASE event_id % 3 WHEN 0 THEN 'save' WHEN 1 THEN 'upsert' ELSE 'delete' END AS op FROM log WHERE event_type = 'MEMORY_RECALLED'),
  b AS (SELECT *, lag(op) OVER (PARTITION BY key ORDER BY event_id) AS before, key IN (SELECT key FROM live) AS lives FROM r),
  a AS (SELECT *, CASE WHEN before IS NULL THEN lives ELSE before <> 'delete' END AS alive FROM b)
  SELECT event_id, op, CASE op WHEN 'save' THEN CASE WHEN alive THEN 'conflict' ELSE 'MEMORY_SAVED' END WHEN 'upsert' THEN CASE WHEN alive THEN 'MEMORY_UPDATED' ELSE 'MEMORY_SAVED' END
  ELSE CASE WHEN alive THEN 'MEMORY_DELETED' END END AS event FROM a""")
def plan_writes(spark, sf):
    log = events(spark, sf)
    op = F.when(F.col("event_id") % 3 == 0, "save").when(F.col("event_id") % 3 == 1, "upsert").otherwise("delete")
    requests = log.filter("event_type = 'MEMORY_RECALLED'").select("event_id", "key", op.alias("op"))
    return lc.plan_writes(requests, mem.live(log), order="event_id").select("event_id", "op", "event")


@query("write_events", _LOG + """SELECT event_id, key, event_type AS event, NULL::BIGINT AS other FROM log WHERE event_type IN ('MEMORY_SAVED', 'MEMORY_UPDATED', 'MEMORY_DELETED')
  UNION ALL SELECT event_id, key, 'MEMORY_SUPERSEDED', last FROM (SELECT event_id, key, max(event_id) OVER (PARTITION BY key) AS last FROM log WHERE event_type = 'MEMORY_SAVED') WHERE event_id < last""")
def write_events(spark, sf):
    return lc.write_events(events(spark, sf))


_SESS = """, s0 AS (SELECT event_id, ms, session_id, CASE WHEN event_type = 'MEMORY_RECALLED' THEN CASE event_id % 2 WHEN 0 THEN 'SESSION_PAUSED' ELSE 'SESSION_RESUMED' END
  WHEN event_type = 'MEMORY_DELETED' AND value > 95 THEN 'SESSION_ENDED' ELSE event_type END AS event_type FROM log),
  s1 AS (SELECT session_id, min(CASE WHEN event_type = 'SESSION_STARTED' THEN ms END) AS started_ms, max(ms) AS last_ms, count(*) FILTER (WHERE event_type = 'SESSION_ENDED') AS ends,
  max_by(event_type, event_id) FILTER (WHERE event_type IN ('SESSION_PAUSED', 'SESSION_RESUMED')) AS state FROM s0 GROUP BY 1),
  s AS (SELECT session_id, started_ms, last_ms, CASE WHEN state = 'SESSION_PAUSED' THEN 'paused' ELSE 'active' END AS status FROM s1 WHERE started_ms IS NOT NULL AND ends = 0)
"""


def _sessions(spark, sf):
    pause = F.when(F.col("event_id") % 2 == 0, "SESSION_PAUSED").otherwise("SESSION_RESUMED")
    kind = F.when(F.col("event_type") == "MEMORY_RECALLED", pause).when((F.col("event_type") == "MEMORY_DELETED") & (F.col("value") > 95), "SESSION_ENDED").otherwise(F.col("event_type"))
    return ev.sessions(events(spark, sf).withColumn("event_type", kind))


@query("session_status", _LOG + _SESS + "SELECT session_id, status FROM s")
def session_status(spark, sf):
    return _sessions(spark, sf).select("session_id", "status")


@query("session_reaper", _LOG + _SESS + f"SELECT session_id, 'SESSION_ENDED' AS event_type, {NOW_MS} - last_ms AS idle_ms FROM s WHERE status <> 'paused' AND {NOW_MS} - last_ms > 3600000")
def session_reaper(spark, sf):
    return lc.reap(_sessions(spark, sf), NOW_MS)


@query("session_capacity", _LOG + _SESS + "SELECT count(*) FILTER (WHERE status = 'active') AS active, greatest(0, 50 - count(*) FILTER (WHERE status = 'active')) AS free FROM s")
def session_capacity(spark, sf):
    return lc.startable(_sessions(spark, sf))


@query("session_list", _LOG + _SESS + "SELECT session_id, started_ms, status FROM s WHERE status = 'active' ORDER BY started_ms DESC, session_id LIMIT 10")
def session_list(spark, sf):
    return lc.list_sessions(_sessions(spark, sf), status="active").select("session_id", "started_ms", "status")


@query("load_context_counts", _LOG + """, l AS (SELECT DISTINCT session_id, session_id // 2 AS source FROM log) SELECT l.session_id, source, coalesce(n, 0) AS loaded
  FROM l LEFT JOIN (SELECT session_id, count(*) AS n FROM log WHERE event_type = 'MEMORY_SAVED' GROUP BY 1) s ON s.session_id = l.source""")
def load_context_counts(spark, sf):
    log = events(spark, sf)
    return lc.loaded_context(log, log.select("session_id", F.expr("session_id div 2").alias("source")).distinct())


@query("auto_checkpoints", _LOG + "SELECT session_id, (ms // 300000 + 1) * 300000 AS due_ms, max(event_id) AS last_event_id, count(*) AS events FROM log GROUP BY 1, 2")
def auto_checkpoints(spark, sf):
    return lc.auto_checkpoints(events(spark, sf))


@query("checkpoint_record", _LOG + _LIVE + """, k AS (SELECT s.session_id, key FROM live JOIN log s USING (event_id, key)) SELECT l.session_id, last_event_id, coalesce(n, 0) AS memory_count, 'nightly' AS description, coalesce(keys, '') AS memory_keys
  FROM (SELECT session_id, max(event_id) AS last_event_id FROM log GROUP BY 1) l LEFT JOIN (SELECT session_id, count(DISTINCT key) AS n, string_agg(DISTINCT key, ',' ORDER BY key) AS keys FROM k GROUP BY 1) USING (session_id)""")
def checkpoint_record(spark, sf):
    log = events(spark, sf)
    return lc.checkpoint_record(log, mem.live(log), "nightly").withColumn("memory_keys", F.array_join(F.col("memory_keys").cast("array<string>"), ","))


@query("checkpoint_snapshot", """SELECT 'base' AS name, '{"total":' || (SELECT count(*) FROM documents) || ',"by":{' || (SELECT string_agg('"' || lang || '":' || n, ',' ORDER BY lang) FROM (SELECT lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang)) || '}}' AS stats""")
def checkpoint_snapshot(spark, sf):
    return lc.snapshot(table(spark, sf, "documents"), "base", "lang")


@query("priority_counts", "SELECT value, (SELECT count(*) FROM orders WHERE o_orderpriority = value) AS n FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('none')) t(value)")
def priority_counts(spark, sf):
    return lc.counts_of(table(spark, sf, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH", "none"])


@query("store_stats", _LOG + "SELECT count(*) AS event_count, count(DISTINCT session_id) AS session_count, (SELECT count(*) FROM (SELECT DISTINCT session_id, ms // 300000 FROM log)) AS checkpoint_count FROM log")
def store_stats(spark, sf):
    log = events(spark, sf)
    return ev.stats(log).crossJoin(lc.auto_checkpoints(log).agg(F.count("*").alias("checkpoint_count")))  # one row each


@query("delete_sessions_all", _LOG + """, c AS (SELECT session_id, session_id * 10 AS checkpoint_id FROM (SELECT DISTINCT session_id FROM log)), i AS (SELECT DISTINCT session_id * 10 AS checkpoint_id, key FROM log WHERE event_type = 'MEMORY_SAVED'),
  g AS (SELECT DISTINCT session_id FROM log WHERE session_id % 3 = 0) SELECT 'items' AS part, count(*) AS n FROM i WHERE checkpoint_id // 10 NOT IN (FROM g) UNION ALL SELECT 'checkpoints', count(*) FROM c WHERE session_id NOT IN (FROM g)
  UNION ALL SELECT 'events', count(*) FROM log WHERE session_id NOT IN (FROM g) UNION ALL SELECT 'orphans', 0""")
def delete_sessions_all(spark, sf):
    log = events(spark, sf)
    checkpoints = log.select("session_id", (F.col("session_id") * 10).alias("checkpoint_id")).distinct()
    items = log.filter("event_type = 'MEMORY_SAVED'").select((F.col("session_id") * 10).alias("checkpoint_id"), "key").distinct()
    left = lc.delete_cascade(log.filter("session_id % 3 = 0"), items, checkpoints, log)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


@query("maintenance_cycle", _LOG + _LIVE + f""", cut AS (SELECT {NOW_MS} - 20 * 86400000 AS a, {NOW_MS} - 5 * 86400000 AS b)
  SELECT 'dedup' AS step, count(*) AS n FROM (SELECT event_id, max(event_id) OVER (PARTITION BY key) AS last FROM log WHERE event_type = 'MEMORY_SAVED') WHERE event_id < last
  UNION ALL SELECT 'live', count(*) FROM live UNION ALL SELECT 'retention', count(*) FROM log, cut WHERE ms < a
  UNION ALL SELECT 'kept', count(*) FROM log, cut WHERE ms >= CASE WHEN event_type = 'MEMORY_RECALLED' THEN b ELSE a END""")
def maintenance_cycle(spark, sf):
    return lc.maintenance(events(spark, sf), NOW_MS, 20)


@query("worklog_types", "SELECT event_id, ts_ms FROM (SELECT event_id, epoch_us(ts) // 1000 AS ts_ms FROM events WHERE event_type IN ('purchase', 'click', 'error', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 100)")
def worklog_types(spark, sf):
    """The log's types under the names of the worklog's: all six are asked for, those that the log lacks find nothing."""
    names = {"MEMORY_SAVED": "TOOL_RUN_RECORDED", "MEMORY_UPDATED": "DIAGNOSTICS_INGESTED", "MEMORY_DELETED": "GIT_OPERATION_RECORDED", "SESSION_STARTED": "AGENT_TASK_STARTED"}
    kind = F.coalesce(*(F.when(F.col("event_type") == a, b) for a, b in names.items()), F.lit("OTHER"))
    log = events(spark, sf).withColumn("event_type", kind)
    return ev.tail(log, [*names.values(), "AGENT_TASK_SUMMARY", "AGENT_TASK_COMPLETED"], 100).select("event_id", F.col("ms").alias("ts_ms"))


# ---- recall ---------------------------------------------------------------------------------------------------------

_PAY = """SELECT user_id AS memory_id, CAST(event_id AS BIGINT) AS event_id, CASE WHEN event_id % 2 = 0 THEN json_object('key', 'k' || user_id, 'sessionId', 's1', 'memory', json_object('value', event_type, 'priority', 'high'))
  ELSE json_object('key', 'k' || user_id, 'memory', json_object('value', event_type)) END AS payload, json_object('priority', 'low', 'category', 'c' || event_id % 5) AS metadata FROM events"""


@query("payload_resolution", f"""SELECT memory_id, json_extract_string(payload, '$.key') AS key, json_extract_string(payload, '$.sessionId') AS session_id, json_extract_string(payload, '$.memory.value') AS value,
  json_extract_string(metadata, '$.category') AS category, coalesce(json_extract_string(payload, '$.memory.priority'), json_extract_string(metadata, '$.priority')) AS priority
  FROM (SELECT memory_id, max_by(payload, event_id) AS payload, max_by(metadata, event_id) AS metadata FROM ({_PAY}) GROUP BY memory_id)""")
def payload_resolution(spark, sf):
    e = table(spark, sf, "events")
    key, value = F.concat(F.lit("k"), "user_id").alias("key"), F.col("event_type").alias("value")
    full = F.to_json(F.struct(key, F.lit("s1").alias("sessionId"), F.struct(value, F.lit("high").alias("priority")).alias("memory")))
    bare = F.to_json(F.struct(key, F.struct(value).alias("memory")))
    meta = F.to_json(F.struct(F.lit("low").alias("priority"), F.concat(F.lit("c"), F.col("event_id") % 5).alias("category")))
    return lc.payload(e.select(F.col("user_id").alias("memory_id"), "event_id", F.when(F.col("event_id") % 2 == 0, full).otherwise(bare).alias("payload"), meta.alias("metadata")))


@query("relevant_exports", """SELECT c_custkey AS memory_id, round(c_acctbal / 10000, 6) AS score, o_orderkey FROM customer JOIN (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY 1) ON o_custkey = c_custkey
  WHERE round(c_acctbal / 10000, 6) >= 0.7 ORDER BY score DESC, memory_id LIMIT 100""")
def relevant_exports(spark, sf):
    scores = table(spark, sf, "customer").select(F.col("c_custkey").alias("memory_id"), F.round(F.col("c_acctbal") / 10000, 6).alias("score"))
    saves = table(spark, sf, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return lc.relevant(scores, saves.select("o_orderkey", F.to_json(F.struct(F.col("o_custkey").alias("memoryId"))).alias("payload"))).select("memory_id", "score", "o_orderkey")


@query("track_access", _LOG + """, t AS (SELECT session_id AS memory_id, 3 AS access_count, min(ms) AS last_ms FROM log GROUP BY 1), a AS (SELECT key AS memory_id, count(*) AS n, max(ms) AS ms FROM log WHERE event_type = 'MEMORY_RECALLED' AND key IS NOT NULL GROUP BY 1)
  SELECT coalesce(t.memory_id, a.memory_id) AS memory_id, coalesce(access_count, 0) + coalesce(n, 0) AS access_count, greatest(last_ms, ms) AS last_ms FROM t FULL JOIN a ON t.memory_id = a.memory_id""")
def track_access(spark, sf):
    log = events(spark, sf)
    tracked = log.groupBy(F.col("session_id").alias("memory_id")).agg(F.lit(3).alias("access_count"), F.min("ms").alias("last_ms"))
    return lc.track_access(tracked, log.filter("event_type = 'MEMORY_RECALLED' and key is not null").select(F.col("key").alias("memory_id"), "ms"))


_OVER = "(CAST(contains(lower(text), 'license') AS INT) + CAST(contains(lower(text), 'email') AS INT) + CAST(contains(lower(text), 'data') AS INT)) / 3.0::DOUBLE"


@query("semantic_recall", f"""WITH s AS (SELECT doc_id, source || lang AS key, source = 'src1' AS own, {_OVER} AS score FROM documents), o AS (SELECT key, max(score) AS score FROM s WHERE own AND score >= 0.2 GROUP BY key),
  x AS (SELECT key, max(score) AS score FROM s WHERE NOT own AND score >= 0.2 GROUP BY key) SELECT * FROM (SELECT key, score, true AS in_session FROM o UNION ALL SELECT key, score, false FROM x WHERE key NOT IN (SELECT key FROM o)) ORDER BY score DESC, key LIMIT 20""")
def semantic_recall(spark, sf):
    d = table(spark, sf, "documents").select("source", F.concat("source", "lang").alias("key"), se.overlap_score(F.col("text"), "the license of data email").alias("score"))
    best = lambda df: df.filter("score >= 0.2 and key is not null").groupBy("key").agg(F.max("score").alias("score"))
    return lc.semantic_recall(best(d.filter("source = 'src1'")), best(d.filter("source <> 'src1'")), 0.2, 20)


@query("proactive_recall", f"""WITH h AS (SELECT 'k' || doc_id % 50 AS key, doc_id AS memory_id, {_OVER} AS score, text AS value FROM documents), b AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, memory_id DESC) AS n FROM h WHERE key NOT IN ('k1')),
  t AS (SELECT key, score, memory_id, value FROM b WHERE n = 1 ORDER BY score DESC, key LIMIT 5) SELECT key, memory_id, score, CASE WHEN length(value) > 200 THEN value[1:200] || '...' ELSE value END AS value
  FROM t WHERE score >= 0.3 AND memory_id % 10 / 10.0 >= 0.5""")
def proactive_recall(spark, sf):
    d = table(spark, sf, "documents")
    hits = d.select(F.concat(F.lit("k"), F.col("doc_id") % 50).alias("key"), F.col("doc_id").alias("memory_id"), se.overlap_score(F.col("text"), "license email data").alias("score"), F.col("text").alias("value"))
    return lc.proactive(hits, d.select(F.col("doc_id").alias("memory_id"), (F.col("doc_id") % 10 / 10.0).alias("relevance")), ["k1"])


@query("recall_formatted", "SELECT 'Recalled (' || count(*) || ')' || chr(10) || string_agg('- ' || n_name || ' [' || n_regionkey || ']', chr(10) ORDER BY n_regionkey DESC, n_name) AS text FROM nation WHERE n_regionkey > 2")
def recall_formatted(spark, sf):
    n = table(spark, sf, "nation").filter("n_regionkey > 2")
    return lc.formatted(n, [-F.col("n_regionkey"), F.col("n_name")], F.concat(F.lit("- "), "n_name", F.lit(" ["), "n_regionkey", F.lit("]")), "Recalled")


@query("hydrate_hits", "SELECT vec_id AS id, source FROM embeddings JOIN documents ON doc_id = vec_id + 100")
def hydrate_hits(spark, sf):
    """Hits of a search with their memories; hits whose memory is gone drop out."""
    memories = table(spark, sf, "documents").select((F.col("doc_id") - 100).alias("id"), "source")
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id")).join(memories, "id")


# ---- alerts ---------------------------------------------------------------------------------------------------------


_FIRES = "b.severity <> r.last_severity OR b.ms - r.last >= 259200000"


@query("alert_escalation", _fold("SELECT user_id AS session_id, event_id, epoch_us(ts) // 1000 AS ms, CASE WHEN event_id % 5 = 0 THEN 'critical' ELSE 'warning' END AS severity FROM events", "session_id", "ms, event_id", ["ms", "event_id", "severity"],
    {"last": "b.ms", "last_severity": "b.severity", "accepted": "true"}, {"last": f"CASE WHEN {_FIRES} THEN b.ms ELSE r.last END", "last_severity": f"CASE WHEN {_FIRES} THEN b.severity ELSE r.last_severity END", "accepted": _FIRES},
    "session_id, ms, event_id, severity, accepted"))
def alert_escalation(spark, sf):
    e = events(spark, sf).select("session_id", "ms", "event_id", F.when(F.col("event_id") % 5 == 0, "critical").otherwise("warning").alias("severity"))
    return st.sequential(e, "session_id", ["ms", "event_id"], lc.escalate_step(86_400_000 * 3))


@query("subscriber_breaker", _LOG + """, f AS (SELECT session_id, event_id, event_type = 'MEMORY_RECALLED' AS bad FROM log), g AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY session_id ORDER BY event_id) AS ok FROM f),
  n AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id, ok ORDER BY event_id) AS n FROM g WHERE bad) SELECT session_id, min(event_id) AS "at" FROM n WHERE n = 2 GROUP BY 1""")
def subscriber_breaker(spark, sf):
    return lc.tripped(events(spark, sf), "session_id", "event_id", F.col("event_type").eqNullSafe("MEMORY_RECALLED"), 2)
