"""Queries over gates, accesses, facts, mentions of a table's names, the soak monitor and hybrid search of all modes."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import entities as en
from engram.operators import index as ix
from engram.operators import lifecycle as lc
from engram.operators import scoring as sc
from engram.operators import search as se
from engram.operators import vector as ve
from engram.operators.soak import soak
from engram.plans.log import _LOG, NOW_MS
from engram.plans.retrieval import _CASE, _CATS, _COS, _Q, _bm25_sql
from engram.plans.stores import _relevance
from engram.registry import query
from engram.sources.tables import events, table

_GATED = "SELECT doc_id, ['decision', 'error', 'fact', 'note'][doc_id % 4 + 1] AS c, CASE WHEN doc_id % 2 = 0 THEN ['source'] ELSE [] END AS p, doc_id % 9 = 0 AS admin FROM documents"


@query("evidence_verdicts", f"""WITH d AS ({_GATED}), m AS (SELECT *, list_filter(CASE c WHEN 'decision' THEN ['rationale'] WHEN 'error' THEN ['source'] WHEN 'fact' THEN ['source'] ELSE [] END, lambda x: NOT list_contains(p, x)) AS missing FROM d)
  SELECT doc_id, admin OR len(missing) = 0 OR c <> 'error' AS passed, CASE WHEN NOT admin AND len(missing) > 0 THEN 'Evidence gate for "' || c || '": missing required metadata fields: ' || array_to_string(missing, ', ') END AS warning FROM m""")
def evidence_verdicts(spark, sf):
    """Gates that warn, one that blocks, and an admin's bypass."""
    c = F.element_at(F.array(*map(F.lit, ["decision", "error", "fact", "note"])), (F.col("doc_id") % 4 + 1).cast("int"))
    d = table(spark, sf, "documents").select("doc_id", c.alias("c"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit("source"))).alias("p"))
    return d.select("doc_id", sc.evidence_verdict(F.col("c"), F.col("p"), F.col("doc_id") % 9 == 0, ("error",)).alias("v")).select("doc_id", "v.*")


_SCORED = f"""{_CASE(sc.PRIORITY, "priority", 1)} * {_CASE(sc.CATEGORY, "category", 1)} * CASE WHEN n > 0 THEN least(1 + log2(n::DOUBLE) * 0.1, 2.0) ELSE 1.0 END
  * pow(1 + (19.0::DOUBLE / 81) * greatest(({NOW_MS} - ms) / 86400000.0::DOUBLE, 0) / {_CASE(sc.STABILITY_DAYS, "category", 30)}, -0.5) * (1 + 0.3 * ln(1.0 + n) * exp(-greatest(({NOW_MS} - ms) / 86400000.0::DOUBLE, 0) * 24 / 168))"""


@query("track_access_scores", _LOG + f""", r AS (SELECT session_id, key, count(*) AS reads, max(ms) AS last FROM log WHERE event_type = 'MEMORY_RECALLED' GROUP BY 1, 2), a AS (SELECT session_id AS memory_id, count(*) AS k, max(ms) AS last FROM log WHERE event_type = 'MEMORY_DELETED' GROUP BY 1),
  m AS (SELECT event_id AS memory_id, ['high', 'normal', 'low'][event_id % 3 + 1] AS priority, [{", ".join(f"'{c}'" for c in _CATS)}][event_id % {len(_CATS)} + 1] AS category, coalesce(reads, 0) AS n, greatest(ms, last) AS ms FROM log LEFT JOIN r ON r.key = log.key AND r.session_id = log.session_id WHERE event_type = 'MEMORY_SAVED'),
  s AS (SELECT memory_id, n, ms, {_SCORED} AS old FROM m), b AS (SELECT coalesce(s.memory_id, a.memory_id) AS memory_id, coalesce(n, 0) + coalesce(k, 0) AS n, greatest(s.ms, a.last) AS ms, a.memory_id IS NOT NULL AS read, old FROM s FULL JOIN a ON a.memory_id = s.memory_id),
  t AS (SELECT b.*, coalesce(m.priority, 'normal') AS priority, coalesce(m.category, 'note') AS category FROM b LEFT JOIN m ON m.memory_id = b.memory_id)
  SELECT memory_id, n::BIGINT AS access_count, ms AS last_ms, round(CASE WHEN read THEN {_SCORED} ELSE old END, 6) AS score FROM t""")
def track_access_scores(spark, sf):
    """Scores after a batch of accesses, some of memories that weren't tracked yet."""
    rel = _relevance(spark, sf)
    reads = events(spark, sf).filter("event_type = 'MEMORY_DELETED'").select(F.col("session_id").alias("memory_id"), "ms")
    tracked = rel.select("memory_id", F.col("accesses").alias("access_count"), "last_ms", "score")
    return lc.access_scores(tracked, reads, rel.select("memory_id", "priority", "category"), NOW_MS).withColumn("score", F.round("score", 6))


@query("compress_facts", r"""WITH d AS (SELECT source, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS norm, min(doc_id) AS memory_id, md5(trim(min_by(text, doc_id), ' ')) AS fact, count(*) AS sources FROM documents GROUP BY 1, 2)
  SELECT source, memory_id, fact, sources FROM d""")
def compress_facts(spark, sf):
    """The facts of each source's memories, once each."""
    m = table(spark, sf, "documents").select("source", F.col("doc_id").alias("memory_id"), F.col("text").alias("value"))
    return sc.facts(m, "source").withColumn("fact", F.md5("fact"))


_NAMES = r"""WITH w AS (SELECT regexp_extract_all(lower(text), '[a-z0-9_]+') AS ws FROM benchmark), n AS (SELECT DISTINCT name FROM (SELECT unnest(list_filter(ws, lambda x: length(x) >= 8)) AS name FROM w UNION ALL SELECT ws[1] || ' ' || ws[2] FROM w)),
  t AS (SELECT doc_id, source, lower(text) AS t, list_distinct(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS ws FROM documents),
  m AS (SELECT doc_id, source, name FROM (SELECT doc_id, source, unnest(ws) AS name FROM t) JOIN n USING (name)
    UNION SELECT doc_id, source, name FROM t JOIN n ON contains(name, ' ') AND contains(t, name) AND regexp_matches(t, '(^|[^a-z0-9_])' || name || '($|[^a-z0-9_])')) """


def _names(spark, sf):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9_]+"), F.lit(0))
    w = table(spark, sf, "benchmark").select(words.alias("ws"))
    pair = w.select(F.concat(F.get("ws", 0), F.lit(" "), F.get("ws", 1)).alias("name"))
    return w.select(F.explode("ws").alias("name")).filter("length(name) >= 8").unionByName(pair)


@query("project_mentions", _NAMES + "SELECT doc_id, name FROM m")
def project_mentions(spark, sf):
    """Which names of a growing table every whole text mentions: long words of the benchmark, and pairs of its words."""
    return en.dictionary_mentions(table(spark, sf, "documents"), "doc_id", "text", _names(spark, sf))


@query("mention_relations", _NAMES + "SELECT source AS project, name AS target, 'related_to' AS type, count(*) AS n FROM m GROUP BY 1, 2 UNION ALL SELECT source, 'python', 'uses', count(*) FROM documents WHERE regexp_matches(text, '(?i)\\bPython\\b') GROUP BY 1".replace("\\\\", "\\"))
def mention_relations(spark, sf):
    """Relations of sources to what their texts mention: names of the table, and one technology."""
    d = table(spark, sf, "documents").select(F.struct("doc_id", "source").alias("doc"), "text")
    named = en.dictionary_mentions(d, "doc", "text", _names(spark, sf)).withColumn("kind", F.lit("project"))
    tech = en.mentions(d, "doc", "text", ("technology",)).filter("name = 'python'").select("doc", "name", "kind")
    return en.relations(named.unionByName(tech).select("doc.source", "name", "kind"), "source")


_DAYS = "d AS (SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, event_type AS gate, event_type IN ('purchase', 'click') AS hard, count(*) % 3 > 0 AS green FROM events GROUP BY 1, 2)"


@query("soak_monitor", f"""WITH RECURSIVE {_DAYS}, b AS (SELECT day, bool_or(hard AND NOT green AND EXISTS (FROM d p WHERE p.gate = d.gate AND p.day = d.day - 1 AND NOT p.green)) AS reset, coalesce(bool_and(green) FILTER (hard), true) AS g,
    coalesce(min((SELECT count(*) FROM d p WHERE p.gate = d.gate AND p.green AND p.day BETWEEN d.day - 9 AND d.day)) FILTER (NOT hard), 10) AS soft_green FROM d GROUP BY day), n AS (SELECT *, row_number() OVER (ORDER BY day) AS i FROM b),
  r AS (SELECT i, day, day AS soak_start, CASE WHEN g THEN 1 ELSE 0 END AS streak, soft_green FROM n WHERE i = 1 UNION ALL SELECT n.i, n.day, CASE WHEN n.reset THEN n.day ELSE r.soak_start END,
    CASE WHEN NOT n.g THEN 0 WHEN n.day = r.day + 1 THEN r.streak + 1 ELSE 1 END, n.soft_green FROM r JOIN n ON n.i = r.i + 1)
  SELECT day, soak_start, streak::INT AS streak, soft_green::INT AS soft_green, least(streak, day - soak_start + 1) >= 3 AND soft_green >= 6 AS clean FROM r""")
def soak_monitor(spark, sf):
    """Days of the log as gates: two hard ones, three soft ones, three green days in a row, six of ten soft ones."""
    hard = F.col("event_type").isin("MEMORY_SAVED", "MEMORY_UPDATED")
    days = events(spark, sf).groupBy(F.floor(F.col("ms") / 86_400_000).alias("day"), F.col("event_type").alias("gate"), hard.alias("hard")).agg((F.count("*") % 3 > 0).alias("green"))
    return soak(days, 3, 6, 10)


# ---- hybrid search --------------------------------------------------------------------------------------------------

_MODES = (
    _bm25_sql({"why": 1, "the": 1, "thing": 1, "failed": 1})
    + f""", kw AS (SELECT doc_id, score FROM bm ORDER BY score DESC, doc_id LIMIT 40), dn AS (SELECT vec_id AS doc_id, {_COS} AS score FROM embeddings ORDER BY score DESC, doc_id LIMIT 40),
  ga AS (SELECT doc_id, 1.0::DOUBLE / length(text) AS score FROM documents JOIN labels USING (doc_id) WHERE quality = 1 ORDER BY score DESC, doc_id LIMIT 40), ca AS (SELECT l_partkey AS doc_id, max(l_discount) AS score FROM lineitem WHERE l_suppkey % 20 = 0 GROUP BY 1 ORDER BY score DESC, doc_id LIMIT 40),
  m AS (SELECT *, 'k' AS m, 0.2 / 1.15 AS w FROM kw UNION ALL SELECT *, 's', 0.3 / 1.15 FROM dn UNION ALL SELECT *, 'g', 0.2 / 1.15 FROM ga UNION ALL SELECT *, 'c', 0.45 / 1.15 FROM ca),
  r AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY score DESC, doc_id) AS rank FROM m), f AS (SELECT doc_id, least(1.0::DOUBLE, sum(w::DOUBLE / (60 + rank)) / sum(w::DOUBLE) * 60) AS score FROM r GROUP BY 1),
  b AS (SELECT f.doc_id, round(CASE WHEN ts IS NULL THEN score ELSE score * (1 + 0.3 * exp(-({NOW_MS} - epoch_us(ts) // 1000) / 86400000.0::DOUBLE / 30)) END, 9) AS score FROM f LEFT JOIN events e ON e.event_id = f.doc_id) """
)


def _hybrid(spark, sf, **options):
    docs, li = table(spark, sf, "documents"), table(spark, sf, "lineitem")
    query_text = "why the thing failed"
    size = docs.select("doc_id", F.length("text").alias("size"))  # texts themselves don't go into the join
    lists = {
        "keyword": ix.bm25(spark, ix.of_table(spark, f"{sf}/documents.parquet", "doc_id", {"text": 1.0}), query_text),
        "semantic": ve.search(table(spark, sf, "embeddings"), _Q, 40).withColumnRenamed("vec_id", "doc_id"),
        "graph": size.join(table(spark, sf, "labels").filter("quality = 1").select("doc_id"), "doc_id").select("doc_id", F.when(F.col("size") == 0, float("inf")).otherwise(1.0 / F.col("size")).alias("score")),
        "causal": li.filter("l_suppkey % 20 = 0").groupBy(F.col("l_partkey").alias("doc_id")).agg(F.max("l_discount").alias("score")),
    }
    ages = events(spark, sf).select(F.col("event_id").alias("doc_id"), ((F.lit(NOW_MS) - F.col("ms")) / 86_400_000).alias("days"))
    return se.hybrid(query_text, lists, ages=ages, limit=20, **options)


@query("hybrid_modes", _MODES + "SELECT doc_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY b.score DESC, doc_id) AS INT) AS rank FROM b WHERE b.score >= 0.5 ORDER BY rank LIMIT 20")
def hybrid_modes(spark, sf):
    """Four modes with the weights of an error's investigation, the causal one lifted by the question."""
    return _hybrid(spark, sf, profile="error_investigation", threshold=0.5).select("doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


@query("hybrid_reranked", _MODES + """, h AS (SELECT doc_id, score FROM b ORDER BY score DESC, doc_id LIMIT 40), s AS (SELECT h.doc_id, coalesce(length(text), 0)::DOUBLE AS score FROM h LEFT JOIN documents d ON d.doc_id = h.doc_id)
  SELECT doc_id, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM s ORDER BY rank LIMIT 20""")
def hybrid_reranked(spark, sf):
    """The same put in order by a reranker, which here likes long texts."""
    found = _hybrid(spark, sf, profile="error_investigation", texts=table(spark, sf, "documents"), rerank=lambda q, ts: [float(len(t)) for t in ts])
    return found.select("doc_id", F.col("rank").cast("int").alias("rank"))
