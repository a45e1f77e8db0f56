"""Queries over graph entities, evolution, projects, diagnostics stores, evaluation and the hooks."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import diagnostics as dg
from engram.operators import graph as gr
from engram.operators import hooks as hk
from engram.operators import projects as pj
from engram.operators import temporal as tp
from engram.plans.structure import _FIND, _IMP, _LINE, _VER, _findings, _history, _imports, _lineage, _seeds, _walk
from engram.registry import query
from engram.sources.tables import millis, table

_NODES = "n AS (SELECT p_partkey AS id, p_name AS name, p_type AS type, p_size AS created, p_brand AS project, NULL::BIGINT AS updated FROM part)"


def _nodes(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("type"), F.col("p_size").alias("created"), F.col("p_brand").alias("project"), F.lit(None).cast("bigint").alias("updated"))


@query("entities_by_type", f"WITH {_NODES} SELECT id, name FROM n WHERE type = (SELECT min(type) FROM n) ORDER BY created DESC, id")
def entities_by_type(spark, sf):
    n = _nodes(spark, sf)
    first = n.agg(F.min("type").alias("type"))
    return gr.by_type(n.join(F.broadcast(first), "type"), F.col("type")).select("id", "name")  # one row


@query("entities_by_ids", f"WITH {_NODES} SELECT id, type FROM n WHERE id IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def entities_by_ids(spark, sf):
    return gr.by_ids(_nodes(spark, sf), table(spark, sf, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("id"))).select("id", "type")


@query("entity_update", f"WITH {_NODES}, c AS (SELECT l_partkey AS id, max(l_linestatus || l_returnflag) AS name FROM lineitem WHERE l_quantity > 45 GROUP BY 1) SELECT id, coalesce(c.name, n.name) AS name, CASE WHEN c.id IS NOT NULL THEN 99 END AS updated FROM n LEFT JOIN c USING (id)")
def entity_update(spark, sf):
    c = table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("id"), F.concat("l_linestatus", "l_returnflag").alias("name"))
    return gr.update_nodes(_nodes(spark, sf), c, 99).select("id", "name", "updated")


@query("batch_upsert_entities", "SELECT id, max(ts) AS ts, max_by(v, (ts, v)) AS v FROM (SELECT o_custkey AS id, epoch_us(o_orderdate) // 1000 AS ts, o_orderkey AS v FROM orders) GROUP BY id")
def batch_upsert_entities(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), millis("o_orderdate").alias("ts"), F.col("o_orderkey").alias("v"))
    return gr.batch_upsert(o.filter("v % 3 = 0"), o.filter("v % 3 <> 0"))


@query("project_sweep", f"""WITH {_NODES}, e AS (SELECT DISTINCT l_partkey AS src, l_partkey + 1 AS dst FROM lineitem WHERE l_quantity > 40), b AS (SELECT min(project) AS p FROM n), k AS (SELECT id FROM n, b WHERE project <> p),
  x AS (SELECT * FROM e WHERE src NOT IN (SELECT id FROM n, b WHERE project = p) AND dst NOT IN (SELECT id FROM n, b WHERE project = p)), o AS (SELECT id FROM k WHERE id NOT IN (SELECT src FROM x UNION SELECT dst FROM x))
  SELECT (SELECT count(*) FROM k) - (SELECT count(*) FROM o) AS nodes, (SELECT count(*) FROM x) AS edges, (SELECT count(*) FROM o) AS orphans""")
def project_sweep(spark, sf):
    n = _nodes(spark, sf)
    first = n.agg(F.min("project").alias("_p"))
    n = n.crossJoin(F.broadcast(first)).withColumn("project", F.when(F.col("project") == F.col("_p"), "gone").otherwise("kept")).drop("_p")  # one row
    e = table(spark, sf, "lineitem").filter("l_quantity > 40").select(F.col("l_partkey").alias("src"), (F.col("l_partkey") + 1).alias("dst")).distinct()
    parts = gr.sweep_orphans(n, e, "project", "gone")
    counts = [df.agg(F.count("*").alias(name)) for df, name in zip(parts, ("nodes", "edges", "orphans"), strict=True)]
    return counts[0].crossJoin(counts[1]).crossJoin(counts[2])  # one row each


_LINER = "e AS (SELECT doc_id AS src, doc_id // 2 AS dst, doc_id AS rel, CASE doc_id % 2 WHEN 0 THEN 'CALLS' ELSE 'USES' END AS type FROM documents WHERE doc_id > 0)"


def _typed(spark, sf):
    return _lineage(spark, sf).withColumns({"rel": F.col("src"), "type": F.when(F.col("src") % 2 == 0, "CALLS").otherwise("USES")})


@query("k_hop_discoveries", f"""WITH RECURSIVE {_LINER}, u AS (SELECT src AS a, dst AS b, rel FROM e UNION ALL SELECT dst, src, rel FROM e), r AS (SELECT 12::BIGINT AS node, 0 AS depth UNION ALL SELECT u.b, depth + 1 FROM r JOIN u ON u.a = r.node WHERE depth < 3),
  d AS (SELECT node, min(depth) AS depth FROM r GROUP BY node) SELECT 12::BIGINT AS seed, d.node, d.depth, min_by(u.a, (u.rel, u.a)) AS via, min(u.rel) AS rel FROM d JOIN u ON u.b = d.node JOIN d p ON p.node = u.a AND p.depth = d.depth - 1 WHERE d.depth > 0 GROUP BY d.node, d.depth""")
def k_hop_discoveries(spark, sf):
    return gr.discoveries(_typed(spark, sf), _seeds(spark, sf, "doc_id = 12"), 3)


@query("lineage_subgraph", _walk("src", "dst", 3, "doc_id % 20 = 0").replace("r AS", "up AS").replace("FROM r", "FROM up").replace("r.node", "up.node") + """, dn AS (SELECT doc_id AS seed, doc_id AS node, 0 AS depth FROM documents WHERE doc_id % 20 = 0
  UNION ALL SELECT seed, e.src, depth + 1 FROM dn JOIN e ON e.dst = dn.node WHERE depth < 3), x AS (SELECT DISTINCT seed, node FROM up UNION SELECT seed, node FROM dn)
  SELECT a.seed, e.src, e.dst FROM e JOIN x a ON a.node = e.src JOIN x b ON b.node = e.dst AND b.seed = a.seed""")
def lineage_subgraph(spark, sf):
    return gr.subgraph(_lineage(spark, sf), _seeds(spark, sf, "doc_id % 20 = 0"))[1]


@query("effects_of", "SELECT l_suppkey AS src, l_partkey AS dst, score FROM (SELECT l_suppkey, l_partkey, l_discount * 10 AS score FROM lineitem WHERE l_suppkey = 3) WHERE score >= 0.5 ORDER BY score DESC, src, dst LIMIT 10")
def effects_of(spark, sf):
    e = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.lit("CAUSES").alias("type"), F.lit(None).cast("double").alias("confidence"), (F.col("l_discount") * 10).alias("weight"))
    return gr.strongest(e, 3, "src").select("src", "dst", "score")


@query("impact_limited", f"""WITH RECURSIVE {_IMP}, r AS (SELECT 't1' AS node, 0 AS depth, 't1' AS via UNION ALL SELECT e.src, depth + 1, via || '>' || e.src FROM r JOIN e ON e.dst = r.node WHERE depth < 2)
  SELECT node AS file, via, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY node, via ORDER BY depth, file, via LIMIT 30""")
def impact_limited(spark, sf):
    back = _imports(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = gr.nearest_paths(back, spark.createDataFrame([("t1",)], "seed string"), 2, 30)[0]
    return found.withColumn("via", F.array_join("via", ">"))


@query("truncation_flag", f"WITH RECURSIVE {_IMP} SELECT least(count(*), 30) AS n, count(*) >= 30 AS truncated FROM e")
def truncation_flag(spark, sf):
    return gr.truncated(_imports(spark, sf).limit(31), 30)


_CODE = "e AS (SELECT DISTINCT 'f' || l_suppkey AS src, CASE WHEN l_partkey % 5 = 0 THEN 'npm:' ELSE 'g' END || l_partkey % 50 AS dst, 'sym' || l_linenumber AS symbol, l_linenumber AS line, l_partkey % 5 = 0 AS external FROM lineitem)"


def _code(spark, sf):
    li = table(spark, sf, "lineitem")
    far = F.col("l_partkey") % 5 == 0
    return li.select(F.concat(F.lit("f"), "l_suppkey").alias("src"), F.concat(F.when(far, "npm:").otherwise("g"), F.col("l_partkey") % 50).alias("dst"), F.concat(F.lit("sym"), "l_linenumber").alias("symbol"), F.col("l_linenumber").alias("line"), far.alias("external")).distinct()


@query("imports_of", f"WITH {_CODE} SELECT dst, symbol, line, external FROM e WHERE src = 'f3' ORDER BY line, src, dst")
def imports_of(spark, sf):
    return gr.imports(_code(spark, sf), "f3").select("dst", "symbol", "line", "external")


@query("imported_by", f"WITH {_CODE} SELECT src, symbol, line FROM e WHERE dst = 'g7' AND NOT external")
def imported_by(spark, sf):
    return gr.imports(_code(spark, sf), "g7", "dst", external=False).select("src", "symbol", "line")


@query("relationship_filter", f"WITH {_LINER} SELECT rel, type FROM e WHERE dst = 6 AND type IN ('CALLS')")
def relationship_filter(spark, sf):
    return gr.filtered(_typed(spark, sf), "incoming", 6, ["CALLS"]).select("rel", "type")


@query("relationship_types", f"WITH {_LINER}, x AS (SELECT src AS node, type FROM e UNION ALL SELECT dst, type FROM e) SELECT node, string_agg(DISTINCT type, ',' ORDER BY type) AS types, count(*) AS n FROM x GROUP BY node")
def relationship_types(spark, sf):
    return gr.type_sets(_typed(spark, sf)).withColumn("types", F.array_join("types", ","))


@query("graph_quality", """SELECT 'null_text' AS measure, count(*) FILTER (WHERE text IS NULL) AS n FROM documents UNION ALL SELECT 'null_source', count(*) FILTER (WHERE source IS NULL) FROM documents
  UNION ALL SELECT 'orphans', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def graph_quality(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text", "source")
    e = table(spark, sf, "labels").select(F.col("doc_id").alias("src"), F.col("doc_id").alias("dst"))
    return gr.quality(d, e, ["text", "source"])


@query("population_chain", "SELECT path AS source, target FROM (SELECT path, lead(path) OVER (ORDER BY path) AS target FROM (SELECT DISTINCT 'src/p' || p_partkey || '.ts' AS path FROM part)) WHERE target IS NOT NULL")
def population_chain(spark, sf):
    return gr.population_chain(table(spark, sf, "part").select(F.concat(F.lit("src/p"), "p_partkey", F.lit(".ts")).alias("path")))


# ---- evolution ------------------------------------------------------------------------------------------------------


@query("store_versions", _VER + """, h AS (SELECT o_custkey, version, ms AS valid_from, valid_to, o_orderkey FROM v), x AS (SELECT o_custkey, max(o_orderkey) + 1 AS o_orderkey FROM orders WHERE o_totalprice > 300000 GROUP BY 1)
  SELECT o_custkey, version, valid_from, CASE WHEN valid_to IS NULL AND o_custkey IN (SELECT o_custkey FROM x) THEN 999 ELSE valid_to END AS valid_to, o_orderkey FROM h
  UNION ALL SELECT o_custkey, (SELECT max(version) + 1 FROM h WHERE h.o_custkey = x.o_custkey), 999, NULL, o_orderkey FROM x""")
def store_versions(spark, sf):
    new = table(spark, sf, "orders").filter("o_totalprice > 300000").groupBy("o_custkey").agg((F.max("o_orderkey") + 1).alias("o_orderkey"))
    return tp.store_version(_history(spark, sf).select("o_custkey", "version", "valid_from", "valid_to", "o_orderkey"), new, "o_custkey", 999)


@query("invalidate_versions", _VER + "SELECT o_custkey, version, CASE WHEN valid_to IS NULL AND o_custkey % 3 = 0 THEN 999 ELSE valid_to END AS valid_to FROM v")
def invalidate_versions(spark, sf):
    h = _history(spark, sf)
    return tp.invalidate(h, h.filter("o_custkey % 3 = 0"), "o_custkey", 999).select("o_custkey", "version", "valid_to")


@query("update_in_place", _VER + "SELECT o_custkey, version, CASE WHEN valid_to IS NULL AND o_custkey % 3 = 0 THEN -1 ELSE o_orderkey END AS o_orderkey FROM v")
def update_in_place(spark, sf):
    h = _history(spark, sf)
    changes = h.filter("o_custkey % 3 = 0").select("o_custkey", F.lit(-1).cast("bigint").alias("o_orderkey")).distinct()
    return tp.update_in_place(h.select("o_custkey", "version", "valid_to", "o_orderkey"), changes, "o_custkey").select("o_custkey", "version", "o_orderkey")


@query("as_known_entity", _VER + "SELECT o_custkey, max(version) AS version FROM v WHERE ms <= 820454400000 AND (valid_to IS NULL OR valid_to > 820454400000) AND ms + o_orderkey % 2 * 100000000000 <= 820454400000 GROUP BY o_custkey")
def as_known_entity(spark, sf):
    h = _history(spark, sf).withColumn("event_time", F.col("ms") + F.col("o_orderkey") % 2 * 100_000_000_000)
    return tp.as_known(h, "o_custkey", F.lit(820_454_400_000)).select("o_custkey", "version")


@query("version_pairs", _VER + "SELECT o_custkey, version, o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY version) AS prev_o_orderkey FROM v")
def version_pairs(spark, sf):
    return tp.version_pairs(_history(spark, sf), "o_custkey", ["o_orderkey"]).select("o_custkey", "version", "o_orderkey", "prev_o_orderkey")


@query("evolution_filtered", _VER + """, c AS (SELECT o_custkey, version, ms AS valid_from, CASE WHEN version = 1 THEN 'created' WHEN valid_to IS NOT NULL THEN 'deleted' ELSE 'updated' END AS change FROM v)
  SELECT o_custkey, version, change FROM c WHERE valid_from BETWEEN 757382400000 AND 852076800000 AND change IN ('created', 'updated') ORDER BY valid_from DESC, o_custkey, version DESC LIMIT 100""")
def evolution_filtered(spark, sf):
    return tp.evolution(_history(spark, sf), "o_custkey", 757_382_400_000, 852_076_800_000, ["created", "updated"]).select("o_custkey", "version", "change")


@query("related_top_per_group", "SELECT o_custkey, o_orderkey, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders) WHERE place <= 3")
def related_top_per_group(spark, sf):
    return tp.top_per_group(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 3).select("o_custkey", "o_orderkey", "place")


@query("compare_evolution", """WITH x AS (SELECT event_id, epoch_us(ts) // 1000 AS ms, user_id FROM events), p AS (SELECT a.event_id AS a, b.event_id AS b FROM x a JOIN x b ON a.user_id = 1 AND b.user_id = 2 AND abs(a.ms - b.ms) <= 3600000)
  SELECT (SELECT count(*) FROM x WHERE user_id = 1) - count(DISTINCT a) AS only_a, (SELECT count(*) FROM x WHERE user_id = 2) - count(DISTINCT b) AS only_b, count(*) AS correlated FROM p""")
def compare_evolution(spark, sf):
    e = table(spark, sf, "events").select("user_id", millis("ts").alias("ms"))
    return tp.compare_evolution(e.filter("user_id = 1").select("ms"), e.filter("user_id = 2").select("ms"), "ms", 3_600_000)


# ---- projects and runs ----------------------------------------------------------------------------------------------

_PROJ = "p AS (SELECT c_nationkey AS root, 'nation' || c_nationkey AS name, count(*) AS files, CAST(sum(c_custkey % 7) AS BIGINT) AS commits, max(c_custkey) AS updated_ms FROM customer GROUP BY c_nationkey)"


def _projects(spark, sf):
    c = table(spark, sf, "customer")
    return c.groupBy(F.col("c_nationkey").alias("root")).agg(F.count("*").alias("files"), F.sum(F.col("c_custkey") % 7).alias("commits"), F.max("c_custkey").alias("updated_ms")).withColumn("name", F.concat(F.lit("nation"), "root"))


@query("project_inventory", f"WITH {_PROJ} SELECT root, name, files FROM p WHERE root IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) ORDER BY files DESC, root LIMIT 8")
def project_inventory(spark, sf):
    roots = table(spark, sf, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("root"))
    return pj.inventory(_projects(spark, sf), "files", 8, roots).select("root", "name", "files")


@query("project_counts", """SELECT project, CAST(coalesce(sum(c), 0) AS BIGINT) AS files, CAST(coalesce(sum(s), 0) AS BIGINT) AS commits FROM (SELECT c_nationkey AS project, 1 AS c, 0 AS s FROM customer UNION ALL SELECT s_nationkey, 0, 1 FROM supplier) GROUP BY project""")
def project_counts(spark, sf):
    return pj.counts(files=table(spark, sf, "customer").select(F.col("c_nationkey").alias("project")), commits=table(spark, sf, "supplier").select(F.col("s_nationkey").alias("project")))


@query("coverage_worst", f"WITH {_PROJ}, q AS (SELECT name, CASE WHEN commits = 0 THEN 1 ELSE files / commits::DOUBLE END AS pct FROM p) SELECT min_by(name, (pct, name)) AS worst, min(pct) AS pct, round(avg(pct), 9) AS mean FROM q")
def coverage_worst(spark, sf):
    p = _projects(spark, sf).select(F.col("name").alias("project"), F.col("files").alias("ingested"), F.col("commits").alias("actual"))
    return pj.coverage(p).withColumn("mean", F.round("mean", 9))


@query("pattern_confidence", "SELECT round(coalesce(avg(l_discount * 10), 0), 9) AS mean, count(*) FILTER (WHERE l_discount * 10 >= 0.5) AS confident, count(*) AS n FROM lineitem")
def pattern_confidence(spark, sf):
    return pj.confidence(table(spark, sf, "lineitem").select((F.col("l_discount") * 10).alias("confidence"))).withColumn("mean", F.round("mean", 9))


_RUNS = "runs AS (SELECT l_suppkey AS analysis_id, l_suppkey AS run_id, l_suppkey % 3 AS project, CASE l_suppkey % 2 WHEN 0 THEN 'O' ELSE 'F' END AS tool, max(l_orderkey) AS created_at FROM lineitem GROUP BY l_suppkey)"


def _runs(spark, sf):
    li = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("analysis_id")).agg(F.max("l_orderkey").alias("created_at"))
    return li.select("analysis_id", F.col("analysis_id").alias("run_id"), (F.col("analysis_id") % 3).alias("project"), F.when(F.col("analysis_id") % 2 == 0, "O").otherwise("F").alias("tool"), "created_at")


@query("delete_project_diagnostics", _FIND + f", {_RUNS} SELECT count(*) AS findings, count(DISTINCT analysis_id) AS runs FROM f WHERE analysis_id NOT IN (SELECT analysis_id FROM runs WHERE project = 1)")
def delete_project_diagnostics(spark, sf):
    _, f = pj.delete_project(_runs(spark, sf), _findings(spark, sf), 1)
    return f.agg(F.count("*").alias("findings"), F.count_distinct("analysis_id").alias("runs"))


@query("save_run", _FIND + "SELECT analysis_id, count(*) AS n FROM f WHERE analysis_id <> 2 GROUP BY 1 UNION ALL SELECT 2, count(*) FROM f WHERE analysis_id = 3")
def save_run(spark, sf):
    runs, f = _runs(spark, sf), _findings(spark, sf)
    new = f.filter("analysis_id = 3").withColumn("analysis_id", F.lit(2).cast("bigint"))
    _, left = pj.save_run(runs, f, runs.filter("analysis_id = 2"), new)
    return left.groupBy("analysis_id").agg(F.count("*").alias("n"))


@query("runs_list", f"WITH {_RUNS} SELECT analysis_id, tool, created_at FROM runs WHERE tool = 'O' ORDER BY created_at DESC, run_id DESC LIMIT 50")
def runs_list(spark, sf):
    return pj.list_runs(_runs(spark, sf), tool="O", project=None).select("analysis_id", "tool", "created_at")


@query("compare_latest_tools", _FIND + f""", {_RUNS}, l AS (SELECT tool, max_by(analysis_id, (created_at, run_id)) AS analysis_id FROM runs GROUP BY tool), x AS (SELECT l.tool, f.file_path, f.severity FROM f JOIN l USING (analysis_id)),
  busy AS (SELECT file_path FROM x GROUP BY 1 HAVING count(*) > 1), s AS (SELECT tool, string_agg(severity || '=' || n, ',' ORDER BY severity) AS severities FROM (SELECT tool, severity, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY 1)
  SELECT tool, count(*) AS total, count(DISTINCT file_path) AS files, count(DISTINCT file_path) FILTER (WHERE file_path IN (FROM busy)) AS overlap_files, min(severities) AS severities FROM x JOIN s USING (tool) GROUP BY tool""")
def compare_latest_tools(spark, sf):
    return pj.compare_latest(_runs(spark, sf), _findings(spark, sf))


@query("attribution_totals", "SELECT count(*) FILTER (WHERE l_linenumber < 5) AS attributed, count(*) FILTER (WHERE NOT l_linenumber < 5) AS unattributed, count(*) AS total FROM lineitem")
def attribution_totals(spark, sf):
    li = table(spark, sf, "lineitem")
    symbols = li.select(F.concat(F.lit("src/file"), "l_partkey", F.lit(".ts")).alias("file_path"), F.lit(1).alias("symbol_id"), F.lit(1).alias("sym_start"), F.lit(4).alias("sym_end")).distinct()
    return pj.attribution_totals(dg.attribute(_findings(spark, sf).withColumn("finding_id", F.monotonically_increasing_id()), symbols))


@query("finding_properties", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, user_id FROM events")
def finding_properties(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", F.col("props").alias("properties"))
    return pj.with_properties(e, "k bigint")


@query("verify_manifest", """SELECT 'd' || doc_id AS path, CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 13 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS status FROM documents WHERE doc_id % 11 <> 0 OR doc_id % 13 <> 0""")
def verify_manifest(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("d"), "doc_id").alias("path"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"))
    now = d.filter("doc_id % 13 <> 0").withColumn("sha256", F.when((F.col("doc_id") % 7 == 0) & (F.col("doc_id") % 11 != 0), "x").otherwise(F.col("sha256")))
    return pj.verify_manifest(d.filter("doc_id % 11 <> 0"), now)


@query("commit_parents", "SELECT 'c' || doc_id AS hash, CASE WHEN doc_id < 2 THEN '' WHEN doc_id // 2 = doc_id // 3 THEN 'c' || doc_id // 2 ELSE array_to_string(list_sort(['c' || doc_id // 2, 'c' || doc_id // 3]), ',') END AS parents FROM documents")
def commit_parents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.concat(F.lit("c"), "doc_id").alias("hash"))
    links = [d.filter("doc_id >= 2").select("hash", F.concat(F.lit("c"), F.expr(f"doc_id div {n}")).alias("parent")) for n in (2, 3)]
    return pj.parents(d.select("hash"), links[0].unionByName(links[1])).withColumn("parents", F.array_join("parents", ","))


@query("files_at_tree", "WITH s AS (SELECT 't' || c_nationkey AS tree, c_custkey AS at_, 'f' || c_custkey AS path, sha256(c_name) AS sha256 FROM customer) SELECT path, sha256 FROM s WHERE tree = (SELECT max_by(tree, (at_, tree)) FROM s)")
def files_at_tree(spark, sf):
    c = table(spark, sf, "customer")
    return pj.files_at(c.select(F.concat(F.lit("t"), "c_nationkey").alias("tree"), F.col("c_custkey").alias("at"), F.concat(F.lit("f"), "c_custkey").alias("path"), F.sha2("c_name", 256).alias("sha256")))


@query("propagate_learning", """WITH l AS (SELECT n_name AS key, n_comment AS value, 'r' || n_regionkey AS project, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 't' || n_nationkey END AS tag FROM (SELECT *, 'about ' || n_name AS n_comment FROM nation)),
  m AS (SELECT n_name AS key, 'r' || r_regionkey AS target, (n_nationkey + r_regionkey) % 5 / 5.0 AS score FROM nation, region) SELECT target AS project, '[Propagated] ' || key AS title, value AS solution, tag || ',propagated-from:' || project || ',cross-project' AS tags
  FROM l JOIN m USING (key) WHERE tag <> '' AND score >= 0.5 AND target <> project""")
def propagate_learning(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    tags = F.when(F.col("n_nationkey") % 4 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("t"), "n_nationkey")))
    learned = n.select(F.col("n_name").alias("key"), F.concat(F.lit("about "), "n_name").alias("value"), F.concat(F.lit("r"), "n_regionkey").alias("project"), tags.alias("tags"))
    matches = n.crossJoin(F.broadcast(r)).select(F.col("n_name").alias("key"), F.concat(F.lit("r"), "r_regionkey").alias("target"), ((F.col("n_nationkey") + F.col("r_regionkey")) % 5 / 5.0).alias("score"))  # five regions
    return pj.propagate(learned, matches).withColumn("tags", F.array_join("tags", ","))


@query("eval_summary", """SELECT o_custkey % 4 AS run, o_orderpriority AS query_type, count(*) AS n, avg(o_totalprice) AS price, quantile_cont(o_orderkey, 0.95) AS p95_ms FROM orders GROUP BY 1, 2
  UNION ALL SELECT o_custkey % 4, NULL, count(*), avg(o_totalprice), quantile_cont(o_orderkey, 0.95) FROM orders GROUP BY 1""")
def eval_summary(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 4).alias("run"), F.col("o_orderpriority").alias("query_type"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("latency_ms"))
    return pj.eval_summary(o, ["price"])


@query("eval_run_deltas", "SELECT *, n - lag(n) OVER (PARTITION BY query_type ORDER BY run) AS n_delta FROM (SELECT o_custkey % 4 AS run, o_orderpriority AS query_type, count(*) AS n FROM orders GROUP BY 1, 2)")
def eval_run_deltas(spark, sf):
    s = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 4).alias("run"), F.col("o_orderpriority").alias("query_type")).agg(F.count("*").alias("n"))
    return pj.run_deltas(s, ["n"])


_Q = "q AS (SELECT conv_id AS id, ['pending', 'processing', 'done'][conv_id % 3 + 1] AS status, min(turn) AS created_ms, CASE WHEN conv_id % 3 = 1 THEN conv_id END AS started_ms FROM conversations WHERE conv_id % 2 = 0 GROUP BY conv_id)"


@query("mining_register_mark", f"""WITH {_Q}, a AS (SELECT * FROM q UNION ALL SELECT DISTINCT conv_id, 'pending', 77, NULL FROM conversations WHERE conv_id % 2 <> 0)
  SELECT id, CASE WHEN id % 5 = 0 THEN 'processing' ELSE status END AS status, created_ms, CASE WHEN id % 5 = 0 THEN 88 ELSE started_ms END AS started_ms FROM a""")
def mining_register_mark(spark, sf):
    c = table(spark, sf, "conversations")
    status = F.element_at(F.array(*map(F.lit, ("pending", "processing", "done"))), (F.col("id") % 3 + 1).cast("int"))
    q = c.filter("conv_id % 2 = 0").groupBy(F.col("conv_id").alias("id")).agg(F.min("turn").cast("bigint").alias("created_ms")).withColumns({"status": status, "started_ms": F.when(F.col("id") % 3 == 1, F.col("id")).cast("bigint")})
    files = c.select(F.col("conv_id").alias("id")).distinct()
    return pj.mark(pj.register_files(q, files, 77), files.filter("id % 5 = 0"), "processing", 88)


@query("insights_list", "SELECT doc_id AS key FROM documents WHERE lang = 'de' ORDER BY n_chars DESC, key LIMIT 20")
def insights_list(spark, sf):
    return pj.insights(table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.col("lang").alias("category"), F.col("n_chars").alias("created_ms")), "de").select("key")


@query("stale_insights", "SELECT DISTINCT o_custkey AS key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 25)")
def stale_insights(spark, sf):
    derived = table(spark, sf, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("source"))
    return pj.stale_insights(derived, table(spark, sf, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("key")))


@query("code_matches", """SELECT path, start_line, score, match_at, span FROM (SELECT 'd' || doc_id AS path, CAST(doc_id AS BIGINT) AS start_line, (length(t) - length(replace(t, 'the', ''))) // 3 AS score, instr(t, 'the') AS match_at, n_chars % 9 AS span
  FROM (SELECT *, lower(text) AS t FROM documents)) WHERE match_at > 0 ORDER BY score DESC, match_at, span, start_line, path LIMIT 10""")
def code_matches(spark, sf):
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), "doc_id").alias("path"), F.col("doc_id").alias("start_line"), (F.col("doc_id") + F.col("n_chars") % 9).alias("end_line"), F.col("text").alias("content"))
    return pj.code_matches(d, "the")


@query("ingest_report", """SELECT 'run' AS stage, 'start' AS status, NULL::BIGINT AS n UNION ALL SELECT 'files', 'complete', count(*) FROM documents UNION ALL SELECT 'bytes', 'complete', CAST(sum(strlen(text)) AS BIGINT) FROM documents
  UNION ALL SELECT 'languages', 'complete', count(DISTINCT lang) FROM documents""")
def ingest_report(spark, sf):
    stages = {"files": F.count("*"), "bytes": F.sum(F.octet_length("text")), "languages": F.count_distinct("lang")}
    return pj.ingest_report(stages, table(spark, sf, "documents"))


# ---- hooks ----------------------------------------------------------------------------------------------------------


def _lengths(texts: list[str]) -> list[float]:
    return [float(len(t)) for t in texts]


@query("rerank_hook", "SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM (SELECT doc_id, CAST(length(text) AS DOUBLE) AS score FROM documents ORDER BY score DESC, doc_id LIMIT 10)")
def rerank_hook(spark, sf):
    hits = table(spark, sf, "documents").select("doc_id", "text", F.lit(0.0).alias("score"))
    return hk.reranked(hits, "q", lambda q, ts: _lengths(ts))


@query("embedding_cache", "SELECT count(*) AS texts, count(*) FILTER (WHERE hit) AS hits, round(count(*) FILTER (WHERE hit) / count(*)::DOUBLE, 9) AS rate FROM (SELECT text IN (SELECT text FROM documents WHERE lang = 'en') AS hit FROM documents)")
def embedding_cache(spark, sf):
    d = table(spark, sf, "documents").select("text", "lang")
    _, cache = hk.embedded(d.filter("lang = 'en'"), lambda ts: [[x] for x in _lengths(ts)])
    return hk.hit_rate(d, cache).withColumn("rate", F.round("rate", 9))


@query("graph_mode_lookup", "SELECT DISTINCT l_orderkey AS memory_id, 0.5::DOUBLE AS similarity FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_partkey IN (24, 25, 6) ORDER BY memory_id LIMIT 20")
def graph_mode_lookup(spark, sf):
    names = gr.neighbours(_lineage(spark, sf), 12).select(F.col("node").cast("string").alias("name"))
    return hk.looked_up(names, table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("memory_id"), F.col("l_partkey").cast("string").alias("name")), 10)


@query("summary_cache", "SELECT n_nationkey AS analysis_id, CASE WHEN n_nationkey % 2 = 0 THEN 'cached' ELSE upper(n_name) || '!' END AS summary FROM nation")
def summary_cache(spark, sf):
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("analysis_id"), F.col("n_name").alias("digest"))
    return hk.summarised(n, lambda ts: [t.upper() + "!" for t in ts], n.filter("analysis_id % 2 = 0").select("analysis_id", F.lit("cached").alias("summary")))


@query("compress_hook", "SELECT n_regionkey AS key, upper(string_agg(n_name, chr(10) ORDER BY n_name)) AS summary FROM nation GROUP BY 1")
def compress_hook(spark, sf):
    return hk.compressed(table(spark, sf, "nation").select(F.col("n_regionkey").alias("key"), F.col("n_name").alias("text")), lambda ts: [t.upper() for t in ts])


@query("chunk_hook", "SELECT n_name AS path, 1 AS start_line, length(n_name) AS end_line, 'file' AS kind FROM nation")
def chunk_hook(spark, sf):
    return hk.chunked(table(spark, sf, "nation").select(F.col("n_name").alias("path"), F.col("n_name").alias("text")), lambda t: [(1, len(t), "file")])


_ANS = """a AS (SELECT n_nationkey AS id, n_name AS name, ['person', 'Robot', 'FILE'][n_nationkey % 3 + 1] AS type, n_nationkey / 25.0::DOUBLE AS confidence FROM nation)"""


def _answers(spark, sf):
    n = table(spark, sf, "nation")
    kind = F.element_at(F.array(*map(F.lit, ("person", "Robot", "FILE"))), (F.col("n_nationkey") % 3 + 1).cast("int"))
    c = (F.col("n_nationkey") / 25.0).alias("confidence")
    e = F.array(F.struct(F.col("n_name").alias("name"), kind.alias("type"), c)).alias("entities")
    r = F.array(F.struct(F.col("n_name").alias("source"), F.lit("nobody").alias("target"), F.lit(None).cast("string").alias("type"), c), F.struct(F.col("n_name").alias("source"), F.col("n_name").alias("target"), F.lit("is").alias("type"), c)).alias("relations")
    link = F.array(F.struct(F.col("n_name").alias("cause"), F.lit("effect").alias("effect"), c)).alias("links")
    return n.select(F.col("n_nationkey").alias("id"), F.to_json(F.struct(e, r, link)).alias("answer"))


@query("model_entities", f"WITH {_ANS} SELECT id, name, CASE WHEN lower(type) IN ('person', 'file') THEN lower(type) ELSE 'concept' END AS type, confidence FROM a WHERE confidence >= 0.7")
def model_entities(spark, sf):
    return hk.model_entities(_answers(spark, sf))


@query("model_relations", f"WITH {_ANS} SELECT id, name AS source, 'nobody' AS target, 'related_to' AS type, confidence AS weight, false AS known FROM a WHERE confidence >= 0.5 UNION ALL SELECT id, name, name, 'is', confidence, confidence >= 0.7 FROM a WHERE confidence >= 0.5")
def model_relations(spark, sf):
    a = _answers(spark, sf)
    return hk.model_relations(a, hk.model_entities(a))


@query("model_confidence", f"WITH {_ANS} SELECT round(avg(confidence), 9) AS mean FROM a WHERE confidence >= 0.7")
def model_confidence(spark, sf):
    return hk.model_entities(_answers(spark, sf)).agg(F.round(F.avg("confidence"), 9).alias("mean"))


@query("causal_discovery", f"WITH {_ANS} SELECT id, name AS src, 'effect' AS dst, confidence FROM a WHERE confidence >= 0.7")
def causal_discovery(spark, sf):
    return hk.causal_links(_answers(spark, sf))


@query("contradictions", """WITH c AS (SELECT o_custkey AS memory_id, o_orderkey AS other, o_totalprice / 500000 AS score, 'a' || o_orderkey AS x FROM orders), t AS (SELECT *, row_number() OVER (PARTITION BY memory_id ORDER BY score DESC, other) AS n FROM c WHERE score >= 0.5)
  SELECT memory_id, other, length(x) % 10 / 10.0::DOUBLE AS confidence FROM t WHERE n <= 3 AND length(x) % 10 / 10.0 >= 0.5""")
def contradictions(spark, sf):
    c = table(spark, sf, "orders").select(F.col("o_custkey").alias("memory_id"), F.col("o_orderkey").alias("other"), (F.col("o_totalprice") / 500000).alias("score"), F.concat(F.lit("a"), "o_orderkey").alias("old"), F.lit("").alias("new"))
    return hk.contradictions(c, lambda ts: [len(t.split("\n---\n")[0]) % 10 / 10 for t in ts], least=0.5)
