"""Queries over diagnostics, graphs, temporal entities and state snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.functions import text as tx
from engram.operators import diagnostics as dg
from engram.operators import graph as gr
from engram.operators import state as st
from engram.operators import temporal as tp
from engram.registry import query
from engram.sources.tables import events, millis, table

_FIND = """WITH f AS (SELECT l_suppkey AS analysis_id, 'src/file' || l_partkey || '.ts' AS file_path, l_linenumber AS start_line, CAST(l_quantity AS INTEGER) AS start_col,
  'TS' || (1000 + l_orderkey % 100) AS rule_id, CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'note' END AS severity, 'order ' || l_orderkey AS message, l_linestatus AS tool,
  l_orderkey, l_partkey FROM lineitem),
  k AS (SELECT *, file_path || '|' || start_line || '|' || start_col || '|0|0|' || rule_id || '|' || severity || '|' || message || '|' AS sort_key FROM f)
"""


def _findings(spark, sf):
    li = table(spark, sf, "lineitem")
    f = li.select(
        F.col("l_suppkey").alias("analysis_id"),
        F.concat(F.lit("src\\file"), "l_partkey", F.lit(".ts")).alias("file_path"),
        F.col("l_linenumber").alias("start_line"),
        F.col("l_quantity").cast("int").alias("start_col"),
        F.lit(None).cast("int").alias("end_line"),
        F.lit(None).cast("int").alias("end_col"),
        F.concat(F.lit("TS"), F.lit(1000) + F.col("l_orderkey") % 100).alias("rule_id"),
        F.when(F.col("l_returnflag") == "R", "ERROR").when(F.col("l_returnflag") == "A", "Warning").otherwise("note").alias("severity"),
        F.concat(F.lit(" order   "), "l_orderkey").alias("message"),
        F.lit(None).cast("string").alias("fingerprint"),
        F.col("l_linestatus").alias("tool"),
        "l_orderkey",
        "l_partkey",
    )
    return dg.normalized(f)


@query("content_ids", _FIND + "SELECT l_orderkey, start_line, sha256(analysis_id || chr(10) || sort_key) AS finding_id FROM k")
def content_ids(spark, sf):
    return _findings(spark, sf).select("l_orderkey", "start_line", "finding_id")


@query("findings_digest", _FIND + "SELECT analysis_id, sha256(string_agg(sort_key, chr(10) ORDER BY sort_key) || chr(10)) AS digest FROM k GROUP BY analysis_id")
def findings_digest(spark, sf):
    return dg.digest(_findings(spark, sf))


@query("analysis_ids", "SELECT o_orderkey, sha256(o_custkey || chr(10) || o_orderstatus || chr(10) || o_orderpriority || chr(10) || '1' || chr(10) || '' || chr(10) || o_orderkey) AS id FROM orders")
def analysis_ids(spark, sf):
    o = table(spark, sf, "orders")
    return o.select("o_orderkey", dg.analysis_id(F.col("o_custkey"), F.col("o_orderstatus"), F.col("o_orderpriority"), F.lit("1"), F.lit(None), F.col("o_orderkey")).alias("id"))


@query("latest_run_per_tool", "SELECT o_custkey, o_orderpriority, o_orderkey AS run_id, epoch_us(o_orderdate) // 1000 AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def latest_run_per_tool(spark, sf):
    runs = table(spark, sf, "orders").select("o_custkey", "o_orderpriority", F.col("o_orderkey").alias("run_id"), millis("o_orderdate").alias("created_at"))
    return dg.latest_runs(runs, "o_custkey", "o_orderpriority")


@query("severity_counts", _FIND + """SELECT analysis_id, count(*) AS total, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings,
  count(*) FILTER (WHERE severity = 'note') AS notes FROM f GROUP BY analysis_id""")
def severity_counts(spark, sf):
    return dg.severity_counts(_findings(spark, sf))


@query("severity_summary", _FIND + "SELECT severity, count(*) AS n FROM f GROUP BY severity")
def severity_summary(spark, sf):
    return dg.severity_summary(_findings(spark, sf))


_SYM = _FIND + """, s AS (SELECT 'src/file' || (p_partkey % 50 + 1) || '.ts' AS file_path, p_partkey AS symbol_id, p_size % 7 AS a, p_size % 7 + p_partkey % 5 AS b FROM part),
  best AS (SELECT l_orderkey, start_line, min_by(symbol_id, (b - a, symbol_id)) AS symbol_id FROM f JOIN s ON s.file_path = f.file_path AND start_line BETWEEN a AND b GROUP BY 1, 2),
  att AS (SELECT f.l_orderkey, f.start_line, f.file_path, severity, l_partkey, symbol_id FROM f LEFT JOIN best USING (l_orderkey, start_line))
"""


def _symbols(spark, sf):
    start = F.col("p_size") % 7
    return table(spark, sf, "part").select(F.concat(F.lit("src/file"), F.col("p_partkey") % 50 + 1, F.lit(".ts")).alias("file_path"), F.col("p_partkey").alias("symbol_id"), start.alias("sym_start"), (start + F.col("p_partkey") % 5).alias("sym_end"))


def _attributed(spark, sf):
    f = _findings(spark, sf).withColumn("finding_id", F.concat_ws("/", "l_orderkey", "start_line"))
    return dg.attribute(f, _symbols(spark, sf))


@query("symbol_attribution", _SYM + "SELECT l_orderkey, start_line, symbol_id FROM att")
def symbol_attribution(spark, sf):
    return _attributed(spark, sf).select("l_orderkey", "start_line", "symbol_id")


@query("by_symbol_rollup", _SYM + "SELECT symbol_id, CAST(sum(n) AS BIGINT) AS total, string_agg(severity || '=' || n, ',' ORDER BY severity) AS severities FROM (SELECT symbol_id, severity, count(*) AS n FROM att GROUP BY 1, 2) GROUP BY symbol_id")
def by_symbol_rollup(spark, sf):
    return dg.by_symbol(_attributed(spark, sf))


@query("by_file_rollup", _SYM + """SELECT file_path, CAST(sum(n) AS BIGINT) AS total, string_agg(x, ',' ORDER BY x) AS symbols FROM (SELECT file_path, coalesce(CAST(symbol_id AS VARCHAR), '-') || '=' || count(*) AS x, count(*) AS n FROM att GROUP BY file_path, symbol_id) GROUP BY file_path""")
def by_file_rollup(spark, sf):
    return dg.by_file(_attributed(spark, sf))


@query("point_in_interval", _SYM + "SELECT l_orderkey, start_line, symbol_id FROM f JOIN s ON s.file_path = f.file_path AND start_line BETWEEN a AND b")
def point_in_interval(spark, sf):
    f = _findings(spark, sf).select("l_orderkey", "start_line", "file_path")
    return dg.interval_join(f, _symbols(spark, sf), "start_line", "sym_start", "sym_end", "file_path", width=4).select("l_orderkey", "start_line", "symbol_id")


@query("line_overlap_join", """WITH s AS (SELECT p_partkey % 50 AS f, p_partkey AS k, p_size AS a, p_size + p_partkey % 9 AS b FROM part)
  SELECT x.k AS a_id, y.k AS b_id FROM s x JOIN s y ON x.f = y.f AND x.a <= y.b AND y.a <= x.b AND x.k < y.k""")
def line_overlap_join(spark, sf):
    s = table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("f"), F.col("p_partkey").alias("a_id"), F.col("p_size").alias("a1"), (F.col("p_size") + F.col("p_partkey") % 9).alias("a2"))
    t = s.select("f", F.col("a_id").alias("b_id"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
    return dg.overlap_join(s, t, ("a1", "a2"), ("b1", "b2"), "f", width=8).filter("a_id < b_id").select("a_id", "b_id")


@query("tool_compare_overlap", _FIND + """, b AS (SELECT file_path FROM f GROUP BY file_path HAVING count(*) > 1)
  SELECT tool, count(*) AS total, count(DISTINCT file_path) AS files, count(DISTINCT file_path) FILTER (WHERE file_path IN (SELECT file_path FROM b)) AS overlap_files FROM f GROUP BY tool""")
def tool_compare_overlap(spark, sf):
    return dg.compare_tools(_findings(spark, sf))


_DIFF = _FIND + """, a AS (SELECT DISTINCT {k} AS x FROM k WHERE analysis_id = 1), b AS (SELECT DISTINCT {k} AS x FROM k WHERE analysis_id IN (2, {also}))
  SELECT x AS {name}, CASE WHEN a.x IS NULL THEN 'introduced' WHEN b.x IS NULL THEN 'resolved' ELSE 'unchanged' END AS status FROM a FULL JOIN b USING (x)"""


@query("diff_analyses_by_line", _DIFF.format(k="sort_key", also=1, name="sort_key"))
def diff_by_line(spark, sf):
    f = _findings(spark, sf)
    return dg.diff(f.filter("analysis_id = 1"), f.filter("analysis_id in (1, 2)"))


@query("diff_analyses_by_id", _DIFF.format(k="sha256(analysis_id || chr(10) || sort_key)", also=3, name="finding_id"))
def diff_by_id(spark, sf):
    f = _findings(spark, sf)
    return dg.diff(f.filter("analysis_id = 1"), f.filter("analysis_id in (2, 3)"), "finding_id")


@query("tree_hash", "SELECT source, sha256(string_agg(x, '' ORDER BY x)) AS tree_hash FROM (SELECT source, doc_id || chr(10) || sha256(text) || chr(10) AS x FROM documents) GROUP BY source")
def tree_hash(spark, sf):
    d = table(spark, sf, "documents").select("source", F.col("doc_id").cast("string").alias("path"), F.sha2(F.encode("text", "utf-8"), 256).alias("sha256"))
    return dg.tree_hash(d, "source")


@query("top_files", _FIND + "SELECT file_path, count(*) AS n FROM f GROUP BY file_path ORDER BY n DESC, file_path LIMIT 5")
def top_files(spark, sf):
    return dg.top_files(_findings(spark, sf))


@query("findings_list", _FIND + "SELECT file_path, start_line, start_col, rule_id FROM f WHERE analysis_id = 7 AND severity = 'error'")
def findings_list(spark, sf):
    f = _findings(spark, sf).filter("analysis_id = 7 and severity = 'error'")
    return f.orderBy("file_path", "start_line", "start_col").select("file_path", "start_line", "start_col", "rule_id")


@query("sarif_parse", "SELECT doc_id AS id, 'lint' AS tool, '2' AS tool_version, 'R1' AS rule_id, 'warning' AS severity, lang AS message, source AS file_path, CAST(doc_id % 97 AS INTEGER) AS start_line FROM documents")
def sarif_parse(spark, sf):
    run = '{"runs":[{"tool":{"driver":{"name":"lint","version":"2"}},"results":[{"ruleId":"R1","level":"Warning","message":{"text":"%s"},"locations":[{"physicalLocation":{"artifactLocation":{"uri":"file://%s"},"region":{"startLine":%d}}}]}]}]}'
    raw = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.format_string(run, "lang", "source", F.col("doc_id") % 97).alias("sarif"))
    return dg.parse_sarif(raw).select("id", "tool", "tool_version", "rule_id", "severity", "message", "file_path", "start_line")


# ---- graphs ---------------------------------------------------------------------------------------------------------

_LINE = "e AS (SELECT doc_id AS src, doc_id // 2 AS dst FROM documents WHERE doc_id > 0)"
_SEED = "doc_id % 20 = 0"


def _lineage(spark, sf):
    return table(spark, sf, "documents").filter("doc_id > 0").select(F.col("doc_id").alias("src"), F.expr("doc_id div 2").alias("dst"))


def _seeds(spark, sf, where="doc_id % 20 = 0"):
    return table(spark, sf, "documents").filter(where).select(F.col("doc_id").alias("seed"))


def _walk(a: str, b: str, depth: int, where: str = _SEED) -> str:
    return f"""WITH RECURSIVE {_LINE}, r AS (SELECT doc_id AS seed, doc_id AS node, 0 AS depth FROM documents WHERE {where}
  UNION ALL SELECT seed, e.{b}, depth + 1 FROM r JOIN e ON e.{a} = r.node WHERE depth < {depth}) """


@query("lineage_ancestors", _walk("src", "dst", 10) + "SELECT seed, node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY seed, node")
def lineage_ancestors(spark, sf):
    return gr.reach(_lineage(spark, sf), _seeds(spark, sf), 10)


@query("lineage_descendants", _walk("dst", "src", 4) + "SELECT seed, node, min(depth) AS depth FROM r WHERE depth > 0 AND node <> seed GROUP BY seed, node")
def lineage_descendants(spark, sf):
    return gr.reach(_lineage(spark, sf), _seeds(spark, sf), 4, "in")


@query("lineage_roots", _walk("src", "dst", 10) + "SELECT seed, node, min(depth) AS depth FROM r WHERE depth > 0 AND node NOT IN (SELECT src FROM e) GROUP BY seed, node")
def lineage_roots(spark, sf):
    return gr.roots(_lineage(spark, sf), _seeds(spark, sf))


@query("lineage_timeline", _walk("src", "dst", 10, "doc_id % 20 = 0").replace("r AS", "up AS").replace("FROM r", "FROM up").replace("r.node", "up.node") + """, dn AS (SELECT doc_id AS seed, doc_id AS node, 0 AS depth FROM documents WHERE doc_id % 20 = 0
  UNION ALL SELECT seed, e.src, depth + 1 FROM dn JOIN e ON e.dst = dn.node WHERE depth < 10) SELECT seed, node, CAST(min(g) AS INTEGER) AS generation FROM (SELECT seed, node, -depth AS g FROM up UNION ALL SELECT seed, node, depth FROM dn) GROUP BY seed, node""")
def lineage_timeline(spark, sf):
    return gr.timeline(_lineage(spark, sf), _seeds(spark, sf, "doc_id % 20 = 0"))


@query("shortest_path", _walk("src", "dst", 10, "true").replace("0 AS depth FROM", "0 AS depth, CAST(doc_id AS VARCHAR) AS via FROM").replace("depth + 1 FROM r", "depth + 1, via || '>' || e.dst FROM r") + "SELECT seed AS source, node AS target, depth AS hops, via FROM r WHERE node = 1 AND depth > 0")
def shortest_path(spark, sf):
    pairs = _seeds(spark, sf, "true").select(F.col("seed").alias("source"), F.lit(1).cast("bigint").alias("target"))
    return gr.shortest_paths(_lineage(spark, sf), pairs).withColumn("via", F.array_join(F.col("via").cast("array<string>"), ">"))


@query("neighbours", f"WITH {_LINE} SELECT DISTINCT CASE WHEN src = 12 THEN dst ELSE src END AS node FROM e WHERE src = 12 OR dst = 12")
def neighbours(spark, sf):
    return gr.neighbours(_lineage(spark, sf), 12)


@query("k_hop_neighbours", f"""WITH RECURSIVE {_LINE}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), r AS (SELECT doc_id AS seed, doc_id AS node, 0 AS depth FROM documents WHERE doc_id % 20 = 0
  UNION SELECT seed, u.b, depth + 1 FROM r JOIN u ON u.a = r.node WHERE depth < 4) SELECT seed, node, min(depth) AS depth FROM r GROUP BY seed, node HAVING min(depth) > 0""")
def k_hop_neighbours(spark, sf):
    return gr.reach(_lineage(spark, sf), _seeds(spark, sf), 4, "both")


_IMP = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey % 40 AS dst FROM lineitem UNION SELECT DISTINCT 'p' || l_partkey % 40, 't' || l_suppkey % 4 FROM lineitem)"


def _imports(spark, sf):
    li = table(spark, sf, "lineitem")
    part = F.concat(F.lit("p"), F.col("l_partkey") % 40)
    a = li.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), part.alias("dst"))
    b = li.select(part.alias("src"), F.concat(F.lit("t"), F.col("l_suppkey") % 4).alias("dst"))
    return a.unionByName(b).distinct()


@query("impact_paths", f"""WITH RECURSIVE {_IMP}, r AS (SELECT 't1' AS node, 0 AS depth, 't1' AS via UNION ALL SELECT e.src, depth + 1, via || '>' || e.src FROM r JOIN e ON e.dst = r.node WHERE depth < 3)
  SELECT node AS file, depth, via FROM r WHERE depth > 0""")
def impact_paths(spark, sf):
    back = _imports(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = gr.paths(back, spark.createDataFrame([("t1",)], "seed string"), 3)
    return found.select(F.col("node").alias("file"), "depth", F.array_join("via", ">").alias("via"))


@query("blast_radius", f"""WITH RECURSIVE {_IMP}, r AS (SELECT 's2' AS node, 0 AS depth UNION ALL SELECT e.dst, depth + 1 FROM r JOIN e ON e.src = r.node WHERE depth < 5)
  SELECT node AS file, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY node""")
def blast_radius(spark, sf):
    return gr.reach(_imports(spark, sf), spark.createDataFrame([("s2",)], "seed string"), 5).select(F.col("node").alias("file"), "depth")


@query("dependency_map", f"WITH {_IMP} SELECT src, count(DISTINCT dst) AS targets FROM e GROUP BY src")
def dependency_map(spark, sf):
    return gr.dependency_map(_imports(spark, sf))


@query("causes_of", "SELECT l_suppkey AS src, l_partkey AS dst, score FROM (SELECT l_suppkey, l_partkey, l_discount * 10 AS score FROM lineitem WHERE l_partkey = 17) WHERE score >= 0.5 ORDER BY score DESC, src, dst LIMIT 10")
def causes_of(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("CAUSES").alias("type"), F.lit(None).cast("double").alias("confidence"), (F.col("l_discount") * 10).alias("weight"))
    return gr.strongest(e, 17, "dst").select("src", "dst", "score")


@query("causal_chain", f"WITH RECURSIVE {_LINE}, r AS (SELECT 333::BIGINT AS node, 0 AS depth, '333' AS via UNION ALL SELECT e.dst, depth + 1, via || '>' || e.dst FROM r JOIN e ON e.src = r.node WHERE depth < 5) SELECT depth AS hops, via FROM r WHERE node = 41 AND depth > 0")
def causal_chain(spark, sf):
    pair = spark.createDataFrame([(333, 41)], "source bigint, target bigint")
    return gr.shortest_paths(_lineage(spark, sf), pair, 5).select("hops", F.array_join(F.col("via").cast("array<string>"), ">").alias("via"))


@query("named_edges", "SELECT n_nationkey AS src, n_regionkey AS dst, n_name AS src_name, coalesce(r_name, CAST(n_regionkey AS VARCHAR)) AS dst_name FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON r_regionkey = n_regionkey")
def named_edges(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region").filter("r_regionkey < 3")
    e = n.select((F.col("n_nationkey") + 100).alias("src"), F.col("n_regionkey").alias("dst"))
    names = n.select((F.col("n_nationkey") + 100).alias("id"), F.col("n_name").alias("name")).unionByName(r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")))
    return gr.named(e, names).withColumn("src", F.col("src") - 100).select("src", "dst", "src_name", "dst_name")


@query("orphan_nodes", "SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def orphan_nodes(spark, sf):
    e = table(spark, sf, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") + 10**9).alias("dst"))
    return gr.orphans(table(spark, sf, "customer").select(F.col("c_custkey").alias("id")), e)


@query("merge_entities", """SELECT name, type, min_by(id, (ts, id)) AS id, min(ts) AS created, max(ts) AS updated, max_by(value, (ts, id)) AS value FROM (SELECT o_orderkey AS id, 'c' || o_custkey % 300 AS name, o_orderpriority AS type,
  epoch_us(o_orderdate) // 1000 AS ts, o_totalprice AS value FROM orders) GROUP BY name, type""")
def merge_entities(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("c"), F.col("o_custkey") % 300).alias("name"), F.col("o_orderpriority").alias("type"), millis("o_orderdate").alias("ts"), F.col("o_totalprice").alias("value"))
    return gr.merge_entities(o.filter("id % 2 = 0"), o.filter("id % 2 = 1"))


@query("create_edges_checked", "SELECT l_suppkey AS src, count(*) AS n FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) AND l_partkey IN (SELECT p_partkey FROM part WHERE p_size > 20) GROUP BY l_suppkey")
def create_edges_checked(spark, sf):
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), "l_suppkey")
    ids = table(spark, sf, "supplier").filter("s_acctbal > 0").select(F.concat(F.lit("s"), "s_suppkey").alias("id")).unionByName(table(spark, sf, "part").filter("p_size > 20").select(F.concat(F.lit("p"), "p_partkey").alias("id")))
    return gr.create_edges(e, ids).groupBy(F.col("l_suppkey").alias("src")).agg(F.count("*").alias("n"))


@query("graph_delete_cascade", "SELECT count(*) AS edges FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 3)")
def graph_delete_cascade(spark, sf):
    e = table(spark, sf, "lineitem").select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"))
    gone = table(spark, sf, "supplier").filter("s_nationkey = 3").select(F.concat(F.lit("s"), "s_suppkey").alias("id"))
    return gr.delete_nodes(gone, e, gone)[1].agg(F.count("*").alias("edges"))


# ---- temporal -------------------------------------------------------------------------------------------------------

_VER = """WITH v AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 1000 AS ms, CAST(row_number() OVER w AS INTEGER) AS version, lead(epoch_us(o_orderdate) // 1000) OVER w AS valid_to FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) """


def _history(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", millis("o_orderdate").alias("ms"))
    return tp.versions(o, "o_custkey", "ms", "o_orderkey")


@query("scd2_history", _VER + "SELECT o_custkey, o_orderkey, version, ms AS valid_from, valid_to FROM v")
def scd2_history(spark, sf):
    return _history(spark, sf).select("o_custkey", "o_orderkey", "version", "valid_from", "valid_to")


@query("as_of_entity", _VER + "SELECT o_custkey, max(version) AS version, max_by(o_orderkey, version) AS o_orderkey FROM v WHERE ms <= 820454400000 AND (valid_to IS NULL OR valid_to > 820454400000) GROUP BY o_custkey")
def as_of_entity(spark, sf):
    return tp.as_of(_history(spark, sf), "o_custkey", F.lit(820_454_400_000)).select("o_custkey", "version", "o_orderkey")


@query("evolution_changes", _VER + "SELECT o_custkey, version, CASE WHEN version = 1 THEN 'created' WHEN valid_to IS NOT NULL THEN 'deleted' ELSE 'updated' END AS change FROM v")
def evolution_changes(spark, sf):
    return tp.changes(_history(spark, sf), "o_custkey").select("o_custkey", "version", "change")


@query("correlated_changes", """WITH x AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, event_type, user_id FROM events) SELECT a.event_id AS a_event_id, b.event_id AS b_event_id, abs(a.ms - b.ms) AS gap
  FROM x a JOIN x b ON a.event_type = 'purchase' AND b.event_type = 'error' AND a.user_id = b.user_id AND abs(a.ms - b.ms) <= 3600000""")
def correlated_changes(spark, sf):
    e = events(spark, sf).select("event_id", "ms", "event_type", "session_id")
    found = tp.correlated(e.filter("event_type = 'MEMORY_SAVED'"), e.filter("event_type = 'MEMORY_DELETED'"), "ms", 3_600_000, "session_id")
    return found.select("a_event_id", "b_event_id", "gap")


@query("common_related", "SELECT l_partkey FROM lineitem WHERE l_suppkey = 1 INTERSECT SELECT l_partkey FROM lineitem WHERE l_suppkey IN (2, 3, 4, 5, 6, 7)")
def common_related(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.filter("l_suppkey = 1").select("l_partkey").intersect(li.filter("l_suppkey between 2 and 7").select("l_partkey"))


@query("timeline_why", r"""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN text || chr(10) || 'Why: turn ' || turn || chr(10) || 'x' || chr(10) || ' see ADR-' || conv_id ELSE text END AS t FROM conversations),
  l AS (SELECT *, list_transform(string_split(t, chr(10)), lambda x: trim(x)) AS l FROM m), f AS (SELECT *, list_filter(l, lambda x: starts_with(x, 'Why:') OR starts_with(x, 'Reason:') OR starts_with(x, 'Fixes #') OR starts_with(x, 'Closes #')
  OR starts_with(x, 'Refs #') OR starts_with(x, 'References:') OR regexp_matches(x, 'ADR-\d+') OR regexp_matches(x, '\(#\d+\)')) AS f FROM l)
  SELECT conv_id, turn, CASE WHEN len(f) > 0 THEN array_to_string(f, '; ') ELSE coalesce(l[1], '') END AS why FROM f""")
def timeline_why(spark, sf):
    c = table(spark, sf, "conversations")
    t = F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("\nWhy: turn "), "turn", F.lit("\nx\n see ADR-"), "conv_id")).otherwise(F.col("text"))
    return c.select("conv_id", "turn", tp.explicit_why(t).alias("why"))


@query("file_history_commits", "SELECT l_orderkey, l_linenumber, coalesce(o_orderstatus, '') AS status FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 3 > 0) ON o_orderkey = l_orderkey")
def file_history_commits(spark, sf):
    li, o = table(spark, sf, "lineitem"), table(spark, sf, "orders").filter("o_orderkey % 3 > 0")
    return li.join(o, li["l_orderkey"] == o["o_orderkey"], "left").select("l_orderkey", "l_linenumber", F.coalesce("o_orderstatus", F.lit("")).alias("status"))


@query("green_streaks", """WITH d AS (SELECT CAST(epoch_us(ts) // 86400000000 AS BIGINT) AS day, sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) / sum(value) < 0.2 AS green FROM events GROUP BY 1),
  i AS (SELECT *, day - row_number() OVER (PARTITION BY green ORDER BY day) AS g FROM d) SELECT min(day) AS first_day, count(*) AS days FROM i WHERE green GROUP BY g""")
def green_streaks(spark, sf):
    e = events(spark, sf)
    d = e.groupBy(F.floor(F.col("ms") / 86_400_000).alias("day")).agg((F.sum(F.when(F.col("event_type") == "MEMORY_DELETED", F.col("value")).otherwise(0.0)) / F.sum("value") < 0.2).alias("green"))
    from pyspark.sql import Window

    green = d.filter("green").withColumn("all", F.lit(0))  # a row a day
    marked = tp.islands(green, "all", ["day"], F.col("day") - F.lag("day").over(Window.partitionBy("all").orderBy("day")) == 1)
    return marked.groupBy("island").agg(F.min("day").alias("first_day"), F.count("*").alias("days")).select("first_day", "days")


# ---- state ----------------------------------------------------------------------------------------------------------


@query("knowledge_upsert", """SELECT o_custkey AS k, min(epoch_us(o_orderdate) // 1000) FILTER (WHERE x) AS created, max(o_totalprice) AS value FROM (SELECT *, true AS x FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1 HAVING o_custkey % 5 <> 0
  UNION ALL SELECT k, coalesce(a.created, b.created), b.value FROM (SELECT o_custkey AS k, min(epoch_us(o_orderdate) // 1000) AS created, max(o_totalprice) AS value FROM orders WHERE o_orderkey % 2 = 1 AND o_custkey % 5 = 0 GROUP BY 1) b
  LEFT JOIN (SELECT o_custkey AS k, min(epoch_us(o_orderdate) // 1000) AS created FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) a USING (k)
  UNION ALL SELECT o_custkey, min(epoch_us(o_orderdate) // 1000), max(o_totalprice) FROM orders WHERE o_orderkey % 2 = 0 AND o_custkey % 5 = 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 1) GROUP BY 1""")
def knowledge_upsert(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), millis("o_orderdate").alias("ms"), "o_totalprice", "o_orderkey")
    agg = lambda df: df.groupBy("k").agg(F.min("ms").alias("created"), F.max("o_totalprice").alias("value"))
    return st.upsert(agg(o.filter("o_orderkey % 2 = 0")), agg(o.filter("o_orderkey % 2 = 1 and k % 5 = 0")), "k", keep=["created"])


@query("replace_rows", "SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, c_acctbal + 1 FROM customer WHERE c_custkey % 3 = 0")
def replace_rows(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return st.replace(c, c.filter("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey")


@query("insert_or_ignore", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def insert_or_ignore(spark, sf):
    return st.ignore(table(spark, sf, "orders").filter("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), table(spark, sf, "customer").select("c_custkey"), "c_custkey")


@query("quota_usage", "SELECT user_id AS agent, round(least(100.0, greatest(sum(value) / 20000 * 100, count(*) / 90.0::DOUBLE * 100)), 2) AS used FROM events GROUP BY user_id")
def quota_usage(spark, sf):
    e = events(spark, sf).groupBy(F.col("session_id").alias("agent")).agg(F.sum("value").alias("b"), F.count("*").alias("n"))
    return e.select("agent", st.usage_percent(F.col("b"), F.lit(20000.0), F.col("n"), F.lit(90.0)).alias("used"))


def _fold(rows: str, key: str, order: str, columns: list[str], first: dict[str, str], then: dict[str, str], out: str) -> str:
    """SQL of a fold by key: ``first`` and ``then`` give the state's columns from a row b and, later, the state before, r."""
    take = ", ".join(f"b.{c}" for c in dict.fromkeys([key, *columns]))
    head, tail = (", ".join(f"{e} AS {n}" for n, e in part.items()) for part in (first, then))
    return f"""WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS n FROM ({rows})), r AS (SELECT {take}, b.n, {head} FROM b WHERE n = 1
  UNION ALL SELECT {take}, b.n, {tail} FROM r JOIN b ON b.n = r.n + 1 AND b.{key} IS NOT DISTINCT FROM r.{key}) SELECT {out} FROM r"""


_EV = "SELECT user_id AS session_id, event_id, epoch_us(ts) // 1000 AS ms, value, event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS key FROM events"
_FITS = "r.used + b.size <= 400 AND r.cnt < 8"


@query("quota_admission", _fold("SELECT user_id AS agent, event_id AS seq, CAST(trunc(value) AS BIGINT) AS size FROM events WHERE event_type = 'purchase'", "agent", "seq", ["seq", "size"],
    {"used": "CASE WHEN b.size <= 400 THEN b.size ELSE 0 END", "cnt": "CASE WHEN b.size <= 400 THEN 1 ELSE 0 END", "admitted": "b.size <= 400"},
    {"used": f"CASE WHEN {_FITS} THEN r.used + b.size ELSE r.used END", "cnt": f"CASE WHEN {_FITS} THEN r.cnt + 1 ELSE r.cnt END", "admitted": _FITS}, "agent, seq, size, admitted"))
def quota_admission(spark, sf):
    e = events(spark, sf).filter("event_type = 'MEMORY_SAVED'")
    return st.admit(e.select(F.col("session_id").alias("agent"), F.col("event_id").alias("seq"), F.col("value").cast("bigint").alias("size")), 400, 8)


def _steps(spark, sf, fn, where="true"):
    e = events(spark, sf).filter(where).select("session_id", "event_id", "ms")
    return st.sequential(e, "session_id", "event_id", fn)


_APART = "b.ms - r.last >= 7200000"


@query("observation_dedup_exact", _fold(_EV, "session_id", "event_id", ["event_id", "ms"], {"last": "b.ms", "accepted": "true"}, {"last": f"CASE WHEN {_APART} THEN b.ms ELSE r.last END", "accepted": _APART}, "session_id, event_id, ms, accepted"))
def observation_dedup_exact(spark, sf):
    return _steps(spark, sf, st.dedup_step(7_200_000))


@query("alert_dedup_sliding", """SELECT user_id AS session_id, event_id, epoch_us(ts) // 1000 AS ms, coalesce(epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY event_id) >= 3600000, true) AS accepted FROM events WHERE event_type = 'error'""")
def alert_dedup_sliding(spark, sf):
    return _steps(spark, sf, st.sliding_step(3_600_000), "event_type = 'MEMORY_DELETED'")


_NEW = "b.ms >= r.opened + 86400000"


@query("rate_limit", _fold(_EV, "session_id", "event_id", ["event_id", "ms"], {"opened": "b.ms", "cnt": "1", "accepted": "true"},
    {"opened": f"CASE WHEN {_NEW} THEN b.ms ELSE r.opened END", "cnt": f"CASE WHEN {_NEW} THEN 1 ELSE r.cnt + 1 END", "accepted": f"{_NEW} OR r.cnt < 3"}, "session_id, event_id, ms, accepted"))
def rate_limit(spark, sf):
    return _steps(spark, sf, st.rate_step(3, 86_400_000))


_GRANT = "b.ms >= r.until OR b.holder = r.owner"


@query("write_locks", _fold(_EV.replace("AS session_id", "AS holder"), "key", "event_id", ["event_id", "ms", "holder"], {"owner": "b.holder", "until": "b.ms + 3600000", "accepted": "true"},
    {"owner": f"CASE WHEN {_GRANT} THEN b.holder ELSE r.owner END", "until": f"CASE WHEN {_GRANT} THEN b.ms + 3600000 ELSE r.until END", "accepted": _GRANT}, "key, event_id, ms, holder, accepted"))
def write_locks(spark, sf):
    e = events(spark, sf).select("key", "event_id", "ms", F.col("session_id").alias("holder"))
    return st.sequential(e, "key", "event_id", st.lock_step(3_600_000))


_QUEUE = """WITH q AS (SELECT conv_id AS id, min(turn) AS created_ms, 1706000000000 + conv_id * 60000 AS started_ms, ['pending', 'processing', 'completed'][conv_id % 3 + 1] AS status FROM conversations GROUP BY conv_id),
  r AS (SELECT id, created_ms, CASE WHEN status = 'processing' AND started_ms < 1706003000000 THEN 'pending' ELSE status END AS status FROM q) """


def _queue(spark, sf):
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.min("turn").alias("created_ms"))
    status = F.element_at(F.array(*map(F.lit, ["pending", "processing", "completed"])), (F.col("id") % 3 + 1).cast("int"))
    return c.withColumns({"started_ms": F.lit(1_706_000_000_000) + F.col("id") * 60_000, "status": status})


@query("mining_recover_oldest", _QUEUE + "SELECT id FROM r WHERE status = 'pending' ORDER BY created_ms, id LIMIT 15")
def mining_recover_oldest(spark, sf):
    return st.oldest_pending(st.recover_stale(_queue(spark, sf), 1_706_006_600_000), 15).select("id")


@query("mining_status_pivot", _QUEUE + "SELECT count(*) FILTER (WHERE status = 'pending') AS pending, count(*) FILTER (WHERE status = 'processing') AS processing, count(*) FILTER (WHERE status = 'completed') AS completed FROM r")
def mining_status_pivot(spark, sf):
    q = st.recover_stale(_queue(spark, sf), 1_706_006_600_000)
    return q.agg(*(F.count_if(F.col("status") == s).alias(s) for s in ("pending", "processing", "completed")))


@query("coalesce_sort", "SELECT o_orderkey FROM orders ORDER BY coalesce(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END, CASE WHEN o_orderstatus = 'O' THEN o_totalprice / 2 END, 0) DESC, o_orderkey LIMIT 25")
def coalesce_sort(spark, sf):
    s, p = F.col("o_orderstatus"), F.col("o_totalprice")
    return table(spark, sf, "orders").orderBy(F.desc(F.coalesce(F.when(s == "F", p), F.when(s == "O", p / 2), F.lit(0.0))), "o_orderkey").limit(25).select("o_orderkey")


@query("manifest_diff", """SELECT path, CASE WHEN a.h IS NULL THEN 'added' WHEN b.h IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS status
  FROM (SELECT doc_id AS path, sha256(text) AS h FROM documents WHERE doc_id % 5 > 0) a FULL JOIN (SELECT doc_id AS path, sha256(text || CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE '' END) AS h FROM documents WHERE doc_id % 5 < 4) b USING (path)""")
def manifest_diff(spark, sf):
    d = table(spark, sf, "documents")
    sha = lambda c: F.sha2(F.encode(c, "utf-8"), 256)
    a = d.filter("doc_id % 5 > 0").select(F.col("doc_id").alias("path"), sha(F.col("text")).alias("a"))
    b = d.filter("doc_id % 5 < 4").select(F.col("doc_id").alias("path"), sha(F.concat("text", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(""))).alias("b"))
    status = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


@query("threshold_alerts", "SELECT CASE WHEN value > 200 THEN 'critical' WHEN value > 150 THEN 'warning' END AS severity, count(*) AS n FROM events WHERE value > 150 GROUP BY 1")
def threshold_alerts(spark, sf):
    rules = spark.createDataFrame([("warning", 150.0, 200.0), ("critical", 200.0, 1e300)], "severity string, low double, high double")
    e = events(spark, sf)
    return e.join(F.broadcast(rules), (e["value"] > rules["low"]) & (e["value"] <= rules["high"])).groupBy("severity").agg(F.count("*").alias("n"))


@query("validation_score", "SELECT source, count(*) AS checks, CAST(greatest(0, least(100, round(avg(CASE WHEN lang = 'en' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 100 - least(5 * count(*) FILTER (WHERE n_chars < 300), 20)))) AS BIGINT) AS score FROM documents GROUP BY source")
def validation_score(spark, sf):
    d = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("checks"), F.avg((F.col("lang") == "en").cast("double")).alias("p"), F.count_if(F.col("n_chars") < 300).alias("w"))
    return d.select("source", "checks", F.greatest(F.lit(0), F.least(F.lit(100), F.round(F.col("p") * 100 - F.least(F.col("w") * 5, F.lit(20))))).cast("bigint").alias("score"))


@query("transcript_messages", "SELECT conv_id, count(*) AS n, md5(string_agg(rn || '. ' || text, chr(10) ORDER BY turn)) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations WHERE role = 'user') WHERE rn <= 100 GROUP BY conv_id")
def transcript_messages(spark, sf):
    from engram.sources import transcripts

    return transcripts.prompts(table(spark, sf, "conversations")).withColumn("prompt", F.md5("prompt"))


_DRIFT = "abs(b.value - r.base) / abs(r.base) * 100 > 20"


@query("point_drift", _fold("SELECT o_custkey, o_orderkey, o_totalprice AS value FROM orders", "o_custkey", "o_orderkey", ["o_orderkey", "value"], {"base": "b.value", "accepted": "false"},
    {"base": f"CASE WHEN {_DRIFT} THEN r.base ELSE b.value END", "accepted": _DRIFT}, "o_custkey, o_orderkey, value, accepted"))
def point_drift(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("value"))
    return st.sequential(o, "o_custkey", "o_orderkey", st.drift_step(20.0))


@query("validation_rules", """SELECT 'price' AS rule, 'error' AS severity, count(*) AS checked, count(*) FILTER (WHERE NOT o_totalprice < 400000) AS failed FROM orders
  UNION ALL SELECT 'status', 'warning', count(*), count(*) FILTER (WHERE o_orderstatus = 'P') FROM orders""")
def validation_rules(spark, sf):
    from engram.operators.validation import Rule, Rules

    rules = Rules(Rule("price", F.col("o_totalprice") < 400000), Rule("status", F.col("o_orderstatus") != "P", "warning"), Rule("off", F.lit(False)))
    rules.enable("off", False)
    return rules.report(table(spark, sf, "orders"))
