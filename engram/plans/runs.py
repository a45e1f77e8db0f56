"""Queries over greedy runs: parts of whole lines, spaced acceptance and rate limits by time, on keys of any size."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import greedy as gd
from engram.plans.structure import _fold
from engram.registry import query
from engram.sources.tables import events, table


@query("packed_lines", """WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, unnest(ls) AS x, generate_subscripts(ls, 1) AS i, len(ls) AS n FROM d),
  s AS (SELECT doc_id, i, n, length(x) AS c, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS t FROM l),
  nx AS (SELECT a.doc_id, a.i, a.n, min(b.i) AS j FROM s a LEFT JOIN s b ON b.doc_id = a.doc_id AND b.i > a.i AND b.t > a.t - a.c + 32000 GROUP BY ALL),
  r AS (SELECT doc_id, i, n, j, 1 AS part FROM nx WHERE i = 1 UNION ALL SELECT nx.doc_id, nx.i, nx.n, nx.j, part + 1 FROM r JOIN nx ON nx.doc_id = r.doc_id AND nx.i = r.j),
  p AS (SELECT doc_id, part, CASE WHEN part > 1 THEN greatest(1, i - 2) ELSE 1 END AS a, least(n, coalesce(j - 1, n) + 2) AS b FROM r)
  SELECT doc_id, part, a::INT AS first_line, b::INT AS last_line, length(array_to_string(ls[a:b], chr(10)))::BIGINT AS n_chars, md5(array_to_string(ls[a:b], chr(10))) AS digest FROM p JOIN d USING (doc_id)""")
def packed_lines(spark, sf):
    """Whole texts in parts of at most 32,000 characters of whole lines, two lines shared with either neighbour."""
    rows = gd.packed_lines(table(spark, sf, "documents"), "doc_id", "text")
    return rows.select(F.col("path").alias("doc_id"), "part", "first_line", "last_line", F.length("content").cast("bigint").alias("n_chars"), F.md5("content").alias("digest"))


_TYPED = "SELECT event_type, event_id, epoch_us(ts) // 1000 AS ms FROM events"
_SPACED = "b.ms - r.last >= 3600000"
_OPENS = "b.ms >= r.opened + 86400000"


def _typed(spark, sf):
    return events(spark, sf).select("event_type", "event_id", "ms")


def _named(rows):
    kinds = {"MEMORY_SAVED": "purchase", "MEMORY_UPDATED": "click", "MEMORY_DELETED": "error", "MEMORY_RECALLED": "view", "SESSION_STARTED": "signup"}
    return rows.withColumn("event_type", F.coalesce(*(F.when(F.col("event_type") == k, v) for k, v in kinds.items())))


@query("spaced_by_type", _fold(_TYPED, "event_type", "ms, event_id", ["event_id", "ms"], {"last": "b.ms", "accepted": "true"}, {"last": f"CASE WHEN {_SPACED} THEN b.ms ELSE r.last END", "accepted": _SPACED}, "event_type, event_id, ms, accepted"))
def spaced_by_type(spark, sf):
    """An hour between accepted events of a type: five keys hold all rows, and each is spread over tasks."""
    return _named(gd.accepted(_typed(spark, sf), "event_type", 3_600_000))


@query("rate_limit_by_type", _fold(_TYPED, "event_type", "ms, event_id", ["event_id", "ms"], {"opened": "b.ms", "cnt": "1", "accepted": "true"},
    {"opened": f"CASE WHEN {_OPENS} THEN b.ms ELSE r.opened END", "cnt": f"CASE WHEN {_OPENS} THEN 1 ELSE r.cnt + 1 END", "accepted": f"{_OPENS} OR r.cnt < 50"}, "event_type, event_id, ms, accepted"))
def rate_limit_by_type(spark, sf):
    """Fifty events of a type in each window of a day, which opens with the first event after the last one ended."""
    return _named(gd.rate_limited(_typed(spark, sf), "event_type", 50, 86_400_000))
