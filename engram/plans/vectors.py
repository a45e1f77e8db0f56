"""Queries over tables of vectors, and over graphs with cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from engram.operators import ann
from engram.operators import graph as gr
from engram.registry import query
from engram.sources.tables import table

_EXACT = """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), e) AS score FROM embeddings, q)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS INT) AS rank, vec_id, round(score, 6) AS score FROM s QUALIFY rank <= 10"""


def _vectors(spark, sf):
    v = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return v, v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")


def _shown(rows):
    return rows.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


@query("vectors_topk_exact", _EXACT)
def vectors_topk_exact(spark, sf):
    """Ten neighbours of each vector whose id is divisible by 20, of all vectors."""
    return _shown(ann.exact_topk(*_vectors(spark, sf)))


@query("vectors_topk_probed", _EXACT)
def vectors_topk_probed(spark, sf):
    """The same by way of the inverted file, all lists being probed and all vectors candidates."""
    v, q = _vectors(spark, sf)
    index = ann.build(v, ann.learn(v))
    return _shown(ann.search(index, v, q, probes=len(index.coder.centroids), candidates=sum(index.sizes.values())))


@query("vectors_ann_recall", "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 20 = 0")
def vectors_ann_recall(spark, sf):
    """Whether the tuned inverted file finds nine in ten of all queries' exact neighbours."""
    v, q = _vectors(spark, sf)
    index = ann.build(v, ann.learn(v))
    found = ann.search(index, v, q, probes=ann.tune(index, v, q))
    share = ann.recall(found, ann.exact_topk(v, q))
    return q.agg(F.count("*").alias("queries")).withColumn("reached", F.lit(share >= 0.9))


# ---- graphs with cycles ---------------------------------------------------------------------------------------------

_RING = "e AS (SELECT DISTINCT l_suppkey AS src, (l_suppkey * 7 + l_linenumber % 3) % 50 AS dst FROM lineitem)"


def _ring(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_suppkey").alias("src"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber") % 3) % 50).alias("dst")).distinct()


def _ends(spark, sf):
    return _ring(spark, sf).select(F.col("src").alias("seed")).filter("seed % 5 = 0").distinct()


def _around(a: str, b: str) -> str:
    return f"""WITH RECURSIVE {_RING}, s AS (SELECT DISTINCT src AS seed FROM e WHERE src % 5 = 0), r AS (SELECT seed, seed AS node, 0 AS depth FROM s
  UNION SELECT seed, e.{b}, depth + 1 FROM r JOIN e ON e.{a} = r.node WHERE depth < 6) SELECT seed, node, min(depth) AS depth FROM r WHERE depth > 0 GROUP BY seed, node"""


@query("cycle_descendants", _around("src", "dst"))
def cycle_descendants(spark, sf):
    """What each node leads to within six hops; a node that cycles lead back to is among its own."""
    return gr.reach(_ring(spark, sf), _ends(spark, sf), 6)


@query("cycle_ancestors", _around("dst", "src"))
def cycle_ancestors(spark, sf):
    return gr.reach(_ring(spark, sf), _ends(spark, sf), 6, "in")


_TRAILS = f"""WITH RECURSIVE {_RING}, s AS (SELECT DISTINCT src AS seed FROM e WHERE src % 5 = 0), r AS (SELECT seed, seed AS node, 0 AS depth, [seed] AS via, []::VARCHAR[] AS used FROM s
  UNION ALL SELECT seed, e.dst, depth + 1, list_append(via, e.dst), list_append(used, e.src || '>' || e.dst) FROM r JOIN e ON e.src = r.node WHERE depth < @depth AND NOT list_contains(used, e.src || '>' || e.dst)) """


@query("trails_all", _TRAILS.replace("@depth", "4") + "SELECT seed, node, depth, array_to_string(via, '>') AS via FROM r WHERE depth > 0")
def trails_all(spark, sf):
    """All trails of up to four edges, which may come back to their nodes but not to their edges."""
    return gr.trails(_ring(spark, sf), _ends(spark, sf), 4).select("seed", "node", "depth", F.array_join(F.col("via").cast("array<string>"), ">").alias("via"))


@query("impact_trails", _TRAILS.replace("@depth", "5") + "SELECT seed, node, depth, array_to_string(via, '>') AS via FROM r WHERE depth > 0 QUALIFY row_number() OVER (PARTITION BY seed ORDER BY depth, node, r.via) <= 100")
def impact_trails(spark, sf):
    """Each node's first hundred trails by depth, end and path; longer ones aren't followed."""
    return gr.trails(_ring(spark, sf), _ends(spark, sf), 5, 100).select("seed", "node", "depth", F.array_join(F.col("via").cast("array<string>"), ">").alias("via"))


@query("trails_between", _TRAILS.replace("@depth", "4") + "SELECT seed, node, depth, array_to_string(via, '>') AS via FROM r WHERE depth > 0 AND node IN (3, 4)")
def trails_between(spark, sf):
    """Trails of up to four edges that end at one of two nodes; steps away from both aren't followed."""
    goals = spark.createDataFrame([(3,), (4,)], "node bigint")
    return gr.trails(_ring(spark, sf), _ends(spark, sf), 4, targets=goals).select("seed", "node", "depth", F.array_join(F.col("via").cast("array<string>"), ">").alias("via"))
