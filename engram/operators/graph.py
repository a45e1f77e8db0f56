"""Graph operators over edges (src, dst, ...): neighbours, k-hop search, lineage, causes, impact, maps, quality.

Reachability runs level by level, each level a join of the frontier and an anti-join of what was visited, at most ten
levels; where paths themselves are the answer, they are carried along as trails, which use no edge twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.session import materialize

DEEPEST = 10
#: Levels that a search compares with one by one before they become one table.
MERGED = 4


def _depth(n: int) -> int:
    return max(1, min(n, DEEPEST))


def touching(edges: DataFrame, node) -> DataFrame:
    """Edges at a node, whatever their direction: a union of two equality filters, a loop counted once."""
    return edges.filter(F.col("src") == node).unionByName(edges.filter((F.col("dst") == node) & (F.col("src") != node)))


def neighbours(edges: DataFrame, node) -> DataFrame:
    t = touching(edges, node)
    return t.select(F.when(F.col("src") == node, F.col("dst")).otherwise(F.col("src")).alias("node")).distinct()


def filtered(edges: DataFrame, direction: str, node, types: list[str] | None = None) -> DataFrame:
    e = {"outgoing": edges.filter(F.col("src") == node), "incoming": edges.filter(F.col("dst") == node)}.get(direction)
    e = touching(edges, node) if e is None else e
    return e.filter(F.col("type").isin(types)) if types else e


def reach(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "out", keep_seeds: bool = False) -> DataFrame:
    """(seed, node, depth): least hops from each seed (column ``seed``) to the nodes that it reaches.

    Along directed edges a seed is among its own nodes if a cycle leads back to it, with the hops of its shortest cycle;
    against no direction it isn't, as an edge isn't used twice. With ``keep_seeds`` a seed has depth 0 instead. Null ends
    lead nowhere.
    """
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("to"))
    if direction == "in":
        step = edges.select(F.col("dst").alias("node"), F.col("src").alias("to"))
    elif direction == "both":
        step = step.unionByName(edges.select(F.col("dst").alias("node"), F.col("src").alias("to")))
    step = step.filter("node is not null and to is not null").distinct()
    start = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth")).filter("seed is not null").distinct()
    front, levels = start, [start] if keep_seeds or direction == "both" else []
    for d in range(1, _depth(depth) + 1):
        new = front.join(step, "node").select("seed", F.col("to").alias("node")).distinct()
        for part in levels:
            new = new.join(part.select("seed", "node"), ["seed", "node"], "left_anti")
        # a level is read by the next join and by the result; written, it is made once
        front = materialize(new.withColumn("depth", F.lit(d)), "frontier")
        if front.isEmpty():
            break
        levels.append(front)
        if len(levels) == MERGED:  # few tables to compare with, whatever the depth
            levels = [materialize(reduce(DataFrame.unionByName, levels), "seen")]
    seen = reduce(DataFrame.unionByName, levels) if levels else start.limit(0)
    return seen if keep_seeds else seen.filter("depth > 0")


def trails(edges: DataFrame, seeds: DataFrame, depth: int, limit: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """(seed, node, depth, via): trails of 1 to ``depth`` edges from each seed, no edge twice; ``via`` lists their nodes.

    Nodes may come again, the seed too; edges between the same nodes are one. ``limit``: of each seed the first so many by
    depth, node, via; a seed with so many shorter trails isn't followed further, and a level is cut to the limit before it
    meets, so at most ``limit`` trails of a seed are carried on, whatever the degree of their nodes. ``targets`` (node): only
    trails that end there; what is farther from all of them than the hops that are left isn't followed.
    """
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).filter("node is not null and to is not null").distinct()
    depth = _depth(depth)
    ends = None
    if targets is not None:
        goals = targets.select(F.col("node").alias("seed")).distinct()
        near = reach(edges, goals, depth, "in", keep_seeds=True).groupBy("node").agg(F.min("depth").alias("left"))
        ends = materialize(near.select(F.col("node").alias("to"), "left"), "left")
    pair = F.struct(F.col("node").alias("a"), F.col("to").alias("b"))
    kind = edges.schema["src"].dataType.simpleString()
    start = seeds.select("seed").filter("seed is not null").distinct()
    front = start.select("seed", F.col("seed").alias("node"), F.array("seed").alias("via"), F.array().cast(f"array<struct<a: {kind}, b: {kind}>>").alias("used"))
    found = None
    order = Window.partitionBy("seed").orderBy("node", "via")
    for d in range(1, depth + 1):
        new = front.join(step, "node").filter(~F.array_contains("used", pair))
        if ends is not None:
            new = new.join(ends, "to").filter(F.col("left") <= depth - d)
        new = new.select("seed", F.col("to").alias("node"), F.array_append("via", F.col("to")).alias("via"), F.array_append("used", pair).alias("used"), *(["left"] if ends is not None else []))
        hit = F.col("left") == 0 if ends is not None else F.lit(True)
        new = new.withColumn("hit", hit)
        if limit is not None and ends is None:
            # the whole level of a seed that goes on is among its first ``limit``
            new = new.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= limit)
        level = materialize(new, "trails")
        if level.isEmpty():
            break
        out = level.filter("hit").select("seed", "node", F.lit(d).alias("depth"), "via")
        found = out if found is None else found.unionByName(out)
        front = level.select("seed", "node", "via", "used")
        if limit is not None:
            full = found.groupBy("seed").agg(F.count("*").alias("n")).filter(F.col("n") >= limit)
            front = front.join(full, "seed", "left_anti")
    if found is None:
        return start.select("seed", F.col("seed").alias("node"), F.lit(1).alias("depth"), F.array("seed").alias("via")).limit(0)
    if limit is None:
        return found
    first = Window.partitionBy("seed").orderBy("depth", "node", "via")
    return found.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= limit).drop("_n")


def paths(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, node, depth, via): all trails; on dense graphs they multiply with depth, which ``trails`` can limit."""
    return trails(edges, seeds, depth)


def shortest_paths(edges: DataFrame, pairs: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """(source, target, hops, via): a least path of each pair (source, target), the smallest among equals; pairs without
    a path, or with equal ends, give none. Each node keeps one path, so levels don't multiply."""
    step = edges.select(F.col("src").alias("node"), F.col("dst").alias("to")).distinct()
    seen = pairs.select(F.col("source").alias("seed")).distinct().select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), F.array("seed").alias("via"))
    front = seen
    for d in range(1, _depth(depth) + 1):
        new = front.join(step, "node").select("seed", F.col("to").alias("node"), F.array_append("via", F.col("to")).alias("via"))
        new = new.groupBy("seed", "node").agg(F.min("via").alias("via")).join(seen.select("seed", "node"), ["seed", "node"], "left_anti")
        front = materialize(new.select("seed", "node", F.lit(d).alias("depth"), "via"), "paths")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    found = seen.filter("depth > 0").select(F.col("seed").alias("source"), F.col("node").alias("target"), F.col("depth").alias("hops"), "via")
    return pairs.join(found, ["source", "target"])


def roots(edges: DataFrame, seeds: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """Ancestors without an outgoing edge."""
    up = reach(edges, seeds, depth)
    return up.join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_anti").select("seed", "node", "depth")


def timeline(edges: DataFrame, seeds: DataFrame, depth: int = DEEPEST) -> DataFrame:
    """(seed, node, generation): ancestors below 0, the seed 0, descendants above; the nearest generation of a node."""
    up = reach(edges, seeds, depth).select("seed", "node", (-F.col("depth")).alias("generation"))
    down = reach(edges, seeds, depth, "in").select("seed", "node", F.col("depth").alias("generation"))
    own = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("generation"))
    every = own.unionByName(up).unionByName(down)
    return every.groupBy("seed", "node").agg(F.min_by("generation", F.struct(F.abs("generation"), "generation")).alias("generation"))


def strongest(edges: DataFrame, node, side: str, least: float = 0.5, limit: int = 10) -> DataFrame:
    """Causes (side dst) or effects (side src) of a node: by confidence, else weight; at least ``least``."""
    c = F.coalesce("confidence", "weight")
    e = edges.filter((F.col(side) == node) & (F.col("type") == "CAUSES")).withColumn("score", c).filter(F.col("score") >= least)
    return e.orderBy(F.desc("score"), "src", "dst").limit(limit)


def named(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends' names, an end without one by its id."""
    a = nodes.select(F.col("id").alias("src"), F.col("name").alias("_a"))
    b = nodes.select(F.col("id").alias("dst"), F.col("name").alias("_b"))
    e = edges.join(a, "src", "left").join(b, "dst", "left")
    return e.withColumns({"src_name": F.coalesce("_a", F.col("src").cast("string")), "dst_name": F.coalesce("_b", F.col("dst").cast("string"))}).drop("_a", "_b")


def dependency_map(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src").agg(F.count_distinct("dst").alias("targets"))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no edge."""
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()
    return nodes.join(ends, "id", "left_anti")


def merge_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by (name, type): the first id stays, the last row's properties win. Columns id, name, type, ts, value."""
    rows = old.unionByName(new)
    return rows.groupBy("name", "type").agg(F.min_by("id", F.struct("ts", "id")).alias("id"), F.min("ts").alias("created"), F.max("ts").alias("updated"), F.max_by("value", F.struct("ts", "id")).alias("value"))


def create_edges(candidates: DataFrame, nodes: DataFrame) -> DataFrame:
    """Candidate edges whose ends both exist."""
    ids = nodes.select("id").distinct()
    return candidates.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays after nodes (id) go with their edges."""
    left = nodes.join(gone, "id", "left_anti")
    kept = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return left, kept


# ---- entities, subgraphs, imports -----------------------------------------------------------------------------------


def by_type(nodes: DataFrame, kind: str) -> DataFrame:
    """Entities of a type, newest first."""
    return nodes.filter(F.col("type") == kind).orderBy(F.desc("created"), "id")


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Entities whose ids are asked for, each once."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def update_nodes(nodes: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """Nodes with the fields of ``changes`` (id and any of the other columns) that aren't null, and the time of the update.

    Unknown ids change nothing; of several changes of an id the last by the order of its columns counts.
    """
    fields = [c for c in changes.columns if c != "id"]
    last = changes.groupBy("id").agg(F.max(F.struct(*fields)).alias("_c"))
    out = nodes.join(last, "id", "left")
    new = {f: F.coalesce(F.col(f"_c.{f}"), F.col(f)) for f in fields}
    return out.withColumns(new | {"updated": F.when(F.col("_c").isNotNull(), F.lit(now)).otherwise(F.col("updated"))}).drop("_c")


def batch_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The nodes after a batch: of the rows of an id the newest by ts stays, batches of any size in one plan."""
    rest = [c for c in old.columns if c not in ("id", "ts")]
    rows = old.unionByName(new).groupBy("id").agg(F.max(F.struct("ts", *rest)).alias("r"))
    return rows.select("id", "r.*")


def sweep_orphans(nodes: DataFrame, edges: DataFrame, project: str, value) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, orphans) that a project's deletion leaves: its nodes and their edges go, then nodes at no edge."""
    gone = nodes.filter(F.col(project) == value).select("id")
    left, kept = delete_nodes(nodes, edges, gone)
    alone = orphans(left, kept)
    return left.join(alone.select("id"), "id", "left_anti"), kept, alone


def discoveries(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "both", types: list[str] | None = None) -> DataFrame:
    """(seed, node, depth, via, rel): each node that a search finds, and the edge that finds it first, by depth and edge id.

    Edges have rel, src, dst, type. ``via`` is the node on the other end of that edge; rows of depth 1 are the first hop's
    relationships.
    """
    e = edges.filter(F.col("type").isin(types)) if types else edges
    out = e.select(F.col("src").alias("via"), F.col("dst").alias("node"), "rel")
    back = e.select(F.col("dst").alias("via"), F.col("src").alias("node"), "rel")
    step = {"out": out, "in": back}.get(direction)
    step = out.unionByName(back) if step is None else step
    plain = step.select(F.col("via").alias("src"), F.col("node").alias("dst"))
    found = reach(plain, seeds, depth, keep_seeds=True)
    before = found.select("seed", F.col("node").alias("via"), (F.col("depth") + 1).alias("depth"))
    met = found.filter("depth > 0").join(step, "node").join(before, ["seed", "via", "depth"])
    return met.groupBy("seed", "node", "depth").agg(F.min(F.struct("rel", "via")).alias("r")).select("seed", "node", "depth", "r.via", "r.rel")


def subgraph(edges: DataFrame, centre: DataFrame, depth: int = 3) -> tuple[DataFrame, DataFrame]:
    """((seed, node, generation), (seed, src, dst)): lineage around a centre and the edges between its nodes."""
    nodes = timeline(edges, centre, depth)
    a, b = (nodes.select("seed", F.col("node").alias(end)) for end in ("src", "dst"))
    return nodes, edges.select("src", "dst").distinct().join(a, "src").join(b, ["seed", "dst"]).select("seed", "src", "dst")


def nearest_paths(edges: DataFrame, seeds: DataFrame, depth: int = 5, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """((file, via, depth), (n, truncated)): impact along trails, the first ``limit`` of each seed by depth, file and path."""
    rows = trails(edges, seeds, depth, limit + 1).select(F.col("node").alias("file"), "via", "depth")
    return rows.orderBy("depth", "file", "via").limit(limit), truncated(rows, limit)


def truncated(rows: DataFrame, limit: int) -> DataFrame:
    """(n, truncated): how many of ``limit`` rows there are, and whether the list was cut; ``rows`` may have one row more."""
    return rows.agg(F.least(F.count("*"), F.lit(limit)).alias("n"), (F.count("*") >= limit).alias("truncated"))


def imports(edges: DataFrame, file, side: str = "src", external: bool = True) -> DataFrame:
    """Imports of a file (side src) or its importers (side dst), in order; edges have src, dst, symbol, line, external."""
    e = edges.filter(F.col(side) == file)
    return (e if external else e.filter(~F.col("external"))).orderBy("line", "src", "dst")


def type_sets(edges: DataFrame) -> DataFrame:
    """(node, types, n): the relationship types at each node and the number of its edges."""
    ends = edges.select(F.col("src").alias("node"), "type").unionByName(edges.select(F.col("dst").alias("node"), "type"))
    per = ends.groupBy("node", "type").agg(F.count("*").alias("n"))
    return per.groupBy("node").agg(F.array_sort(F.collect_set("type")).alias("types"), F.sum("n").alias("n"))


def quality(nodes: DataFrame, edges: DataFrame, columns: list[str]) -> DataFrame:
    """(measure, n): null counts of node columns, then nodes at no edge."""
    nulls = nodes.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns))
    out = nulls.select(F.explode(F.array(*(F.struct(F.concat(F.lit("null_"), F.lit(c)).alias("measure"), F.col(c).alias("n")) for c in columns))).alias("r")).select("r.*")
    return out.unionByName(orphans(nodes, edges).agg(F.lit("orphans").alias("measure"), F.count("*").alias("n")))


def population_chain(files: DataFrame) -> DataFrame:
    """(source, target): the declared population's order as edges between neighbours by path.

    Ranges of paths are sorted apart and the range's last file meets the next range's first, so no task sees all files.
    """
    spark = files.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = materialize(files.select("path").distinct().repartitionByRange(n, "path").withColumn("_part", F.spark_partition_id()), "population")
    inside = placed.withColumn("target", F.lead("path").over(Window.partitionBy("_part").orderBy("path")))
    ends = placed.groupBy("_part").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    # at most as many rows as partitions
    seams = ends.select(F.col("last").alias("source"), F.lead("first").over(Window.orderBy("first")).alias("target")).filter("target is not null")
    return inside.filter("target is not null").select(F.col("path").alias("source"), "target").unionByName(seams)


def freshness(actual: str | None, expected: str | None, required: bool = True) -> str:
    """Whether an answer's corpus hash still holds: stale, unavailable if nobody asked, else current."""
    if expected and expected != actual:
        return "stale"
    return "current" if required else "unavailable"
