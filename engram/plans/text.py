"""Queries over text structure: entities, mentions, code, history, knowledge statistics, streams replayed as batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import entities as en
from engram.operators import code
from engram.registry import query
from engram.sources import files as fl
from engram.sources.tables import events, table
from engram.streaming import feeds


@query("entity_extract", r"""SELECT DISTINCT doc_id, 'ERROR' AS type, trim(n) AS name FROM (SELECT doc_id, unnest(regexp_extract_all(t, '\b([A-Z][a-zA-Z]*(?:Error|Exception|Fault))\b', 1)) AS n
  FROM (SELECT doc_id, text || ' KeyError ' || CASE WHEN doc_id % 2 = 0 THEN 'IoFault' ELSE '' END AS t FROM documents))""")
def entity_extract(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat("text", F.lit(" KeyError "), F.when(F.col("doc_id") % 2 == 0, "IoFault").otherwise("")).alias("t"))
    return en.extract(d, "doc_id", "t", {"ERROR": [en.PATTERNS["ERROR"][1]]}).select("doc_id", "type", "name")


@query("entity_extract_all")
def entity_extract_all(spark, sf):
    return en.extract(table(spark, sf, "documents"), "doc_id", "text")


_SQL_TYPES = {t: en.PATTERNS[t] for t in ("CODE_FILE", "CODE_FUNCTION", "DECISION", "TASK", "ERROR", "CONCEPT", "CODE_CLASS")}
#: What is put behind each text, as prose of the tables names few things.
_NOTE = r"""' We decided to keep ' || @ || '. TODO: read src/' || @ || '.py; load(x) failed to parse. The repository pattern of class Store extends Base'"""
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, lang, '{t}' AS type, {max(0.3, min(1.0, 1 / len(ps) + 0.5))!r}::DOUBLE AS c, unnest(regexp_extract_all(text, '{p}', 1)) AS a, unnest(regexp_extract_all(text, '{p}', 0)) AS b FROM d"
    for t, ps in _SQL_TYPES.items() for p in (p.replace("'", "''") if isinstance(p, str) else rf"(?i)\b([a-z]{{2,}}(?:\s+[a-z]{{2,}})*)\s+{p[1]}" for p in ps)
)


@query("entity_confidence", rf"""WITH d AS (SELECT doc_id, lang, text || {_NOTE.replace("@", "source")} AS text FROM documents), m AS ({_MATCHES}), n AS (SELECT *, CASE WHEN trim(a, E' \t\n\r\f\v') = '' THEN trim(b, E' \t\n\r\f\v') ELSE trim(a, E' \t\n\r\f\v') END AS name FROM m),
  k AS (SELECT doc_id, type, max(least(1.0, CASE WHEN type IN ('CODE_FILE', 'CODE_FUNCTION', 'CODE_CLASS') THEN c * 1.2 WHEN type = 'TASK' THEN c * 1.2 ELSE c END)) AS confidence, lower(CASE WHEN type = 'CODE_FILE' THEN name ELSE regexp_replace(name, '[.,;:!?]+$', '') END) AS low FROM n
    WHERE length(name) >= 2 AND lower(name) NOT IN ({", ".join(f"'{w}'" for w in en.COMMON)}) AND NOT (type = 'CODE_FUNCTION' AND lower(name) IN ({", ".join(f"'{w}'" for w in en.COMMON_FUNCTIONS)})) GROUP BY ALL),
  c AS (SELECT doc_id, count(*) AS entities, max(confidence) AS best FROM k GROUP BY 1), r AS (SELECT doc_id, entities, best, entities / greatest(1.0, length(text) / 100) AS ratio FROM d JOIN c USING (doc_id))
  SELECT doc_id, entities, round(best, 9) AS best, round(CASE WHEN ratio < 0.5 THEN ratio * 0.8 WHEN ratio > 3 THEN greatest(0.5, 1 - (ratio - 3) * 0.1) ELSE least(0.95, 0.6 + ratio * 0.15) END, 9) AS overall FROM r""")
def entity_confidence(spark, sf):
    """Entities of a text saved under a task's key in a technical category, and how far they can be trusted."""
    d = table(spark, sf, "documents").select("doc_id", F.expr("text || " + _NOTE.replace("@", "source")).alias("text"))
    found = en.extract(d, "doc_id", "text", _SQL_TYPES, key=F.lit("next_task"), category=F.lit("technical"))
    n = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("entities"), F.max("confidence").alias("best"))
    size = d.select("doc_id", F.length("text").alias("size"))  # texts themselves don't go into the join
    return size.join(n, "doc_id").select("doc_id", "entities", F.round("best", 9).alias("best"), F.round(en.overall_confidence(F.col("entities"), F.col("size")), 9).alias("overall"))


@query("tech_mentions", r"""SELECT DISTINCT item_id, 'technology' AS kind, lower(n) AS name FROM (SELECT item_id, unnest(regexp_extract_all(t, '(?i)\b(Python|Redis|Go)\b', 1)) AS n FROM (SELECT item_id, 'uses Python and redis or go ' AS t FROM benchmark))""")
def tech_mentions(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.lit("uses Python and redis or go ").alias("t"))
    return en.mentions(b, "item_id", "t")


def _sources(spark, sf):
    """Files made of documents: each line of prose becomes a comment above a function."""
    body = F.concat(F.lit("import json as _j, os\nfrom .base import helper\nclass C"), F.col("doc_id"), F.lit(":\n    def run(self):\n        # "), F.translate("text", "\n'\"#", "    "), F.lit("\n        return 1\n\ndef tail():\n    '''doc'''\n    return 2"))
    return table(spark, sf, "documents").select(F.concat("source", F.lit("/m"), "doc_id", F.lit(".py")).alias("file_path"), body.alias("content"))


@query("symbols_py", """SELECT source || '/m' || doc_id || '.py' AS file_path, unnest([{'kind': 'class', 'name': 'C' || doc_id, 'first_line': 3, 'last_line': 9}, {'kind': 'function', 'name': 'run', 'first_line': 4, 'last_line': 7},
  {'kind': 'function', 'name': 'tail', 'first_line': 8, 'last_line': 10}], recursive := true) FROM documents""".replace("'last_line': 9", "'last_line': 10"))
def symbols_py(spark, sf):
    return code.extract_symbols(_sources(spark, sf)).select("file_path", "kind", "name", "first_line", "last_line")


@query("imports_py", """SELECT source || '/m' || doc_id || '.py' AS file_path, unnest(['json', 'os', source || '/base']) AS target, unnest(['json', 'os', 'helper']) AS name, unnest([1, 1, 2]) AS line, true AS is_external FROM documents""")
def imports_py(spark, sf):
    return code.extract_imports(_sources(spark, sf)).select("file_path", "target", "name", "line", "is_external")


@query("chunk_comments", """SELECT source || '/m' || doc_id || '.py' AS file_path, unnest(['code', 'comment', 'code', 'docstring', 'code']) AS kind FROM documents""")
def chunk_comments(spark, sf):
    return code.chunk_comments(_sources(spark, sf)).select("file_path", "kind")


@query("chunk_semantic")
def chunk_semantic(spark, sf):
    return code.chunk_semantic(_sources(spark, sf))


@query("git_history", "SELECT 'c' || doc_id AS commit, lang AS author, source AS subject, unnest(['M', 'R']) AS status, unnest([source || '.py', 'new.py']) AS path, unnest([NULL, 'old.py']) AS old_path FROM documents")
def git_history(spark, sf):
    record = F.concat(F.concat_ws("\x1f", F.concat(F.lit("c"), "doc_id"), "lang", F.lit("2024-01-01"), "source"), F.lit("\nM\t"), "source", F.lit(".py\nR100\told.py\tnew.py"))
    return fl.parse_log(table(spark, sf, "documents").select(record.alias("record"))).drop("at")


@query("diff_hunks", "SELECT doc_id AS commit, source AS path, CAST(doc_id + 1 AS INTEGER) AS old_start, 2 AS old_lines, 7 AS new_start, 1 AS new_lines FROM documents")
def diff_hunks(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("commit"), F.col("source").alias("path"), F.concat(F.lit("--- a\n+++ b\n@@ -"), F.col("doc_id") + 1, F.lit(",2 +7 @@ f\n x")).alias("diff"))
    return fl.parse_hunks(d)


@query("knowledge_stats", "SELECT source AS project, count(*) AS entries FROM documents GROUP BY source")
def knowledge_stats(spark, sf):
    return table(spark, sf, "documents").groupBy(F.col("source").alias("project")).agg(F.count("*").alias("entries"))


@query("cross_project_matches", "SELECT id, score FROM (SELECT doc_id AS id, source, (contains(lower(text), 'thing')::INT + contains(lower(text), 'licensed')::INT) / 2.0::DOUBLE AS score FROM documents) WHERE source <> 'src2' AND score >= 0.5 ORDER BY score DESC, id LIMIT 5")
def cross_project_matches(spark, sf):
    from engram.operators.search import overlap_score

    e = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("project"), "text")
    return en.cross_project(e, "src2", overlap_score(F.col("text"), "thing licensed")).select("id", "score")


@query("tumbling_windows", "SELECT CAST(epoch_us(ts) // 3600000000 AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def tumbling_windows(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return feeds.tumbling_counts(e, "1 hour").select(F.floor(F.unix_seconds("start") / 3600).alias("hour"), "event_type", "n")


@query("session_window_counts", """SELECT user_id, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
  SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 3600000000 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY 1, 2) GROUP BY user_id""")
def session_window_counts(spark, sf):
    e = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), "user_id")
    return feeds.session_counts(e).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("change_feed", "SELECT event_id, CASE WHEN scope = 'public' OR owner = 3 THEN value END AS value FROM (SELECT event_id, value, user_id % 7 AS owner, ['public', 'private', 'shared', 'role'][event_id % 4 + 1] AS scope, user_id % 2 AS role FROM events) WHERE owner = 3 OR scope IN ('public', 'shared') OR (scope = 'role' AND role = 1)")
def change_feed(spark, sf):
    scope = F.element_at(F.array(*map(F.lit, ["public", "private", "shared", "role"])), (F.col("event_id") % 4 + 1).cast("int"))
    e = events(spark, sf).select("event_id", "value", (F.col("session_id") % 7).cast("string").alias("agent_id"), scope.alias("agent_scope"), (F.col("session_id") % 2).cast("string").alias("agent_role"))
    return feeds.change_feed(e, agent="3", role="1").select("event_id", "value")
