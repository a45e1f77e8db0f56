"""Trails and reach on graphs with cycles, and vector search, against loops; null, empty and repeated rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.operators import ann
from engram.operators import graph as gr


def random_edges(seed, nodes=8, n=20):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)]


def brute_trails(edges, seed, depth):
    edges, out, front = set(edges), [], [(seed,)]
    for d in range(1, depth + 1):
        new = []
        for via in front:
            used = set(zip(via, via[1:], strict=False))
            new += [(*via, b) for a, b in edges if a == via[-1] and (a, b) not in used]
        out += [(seed, v[-1], d, v) for v in new]
        front = new
    return out


def frames(spark, edges, seeds):
    e = spark.createDataFrame([(a, b, "x") for a, b in edges], "src int, dst int, type string")
    return e, spark.createDataFrame([(s,) for s in seeds], "seed int")


def got(df):
    return sorted((r.seed, r.node, r.depth, tuple(r.via)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_trails(spark, seed):
    edges = random_edges(seed)
    e, s = frames(spark, [*edges, *edges[:3], (None, 1), (2, None)], [0, 1, 1, None])
    want = sorted(t for x in (0, 1) for t in brute_trails(edges, x, 4))
    assert got(gr.trails(e, s, 4)) == want
    assert any(t[0] in t[3][1:] for t in want), "some trail comes back"
    for limit in (1, 7, 40):
        first = [t for x in (0, 1) for t in sorted((t for t in want if t[0] == x), key=lambda t: (t[2], t[1], t[3]))[:limit]]
        assert got(gr.trails(e, s, 4, limit)) == sorted(first)
    goals = spark.createDataFrame([(5,), (6,), (6,)], "node int")
    assert got(gr.trails(e, s, 4, targets=goals)) == [t for t in want if t[1] in (5, 6)]


@pytest.mark.parametrize("seed", [3, 4])
def test_reach_on_cycles(spark, monkeypatch, seed):
    monkeypatch.setattr(gr, "MERGED", 2)
    edges = random_edges(seed, 12, 16) + [(7, 7)]
    e, s = frames(spark, edges, range(12))
    for direction, step in (("out", set(edges)), ("in", {(b, a) for a, b in edges})):
        want = {}
        for x in range(12):
            front, seen = {x}, {}
            for d in range(1, 7):
                front = {b for a, b in step if a in front}
                for n in front:
                    seen.setdefault(n, d)
            want |= {(x, n): d for n, d in seen.items()}
        assert {(r.seed, r.node): r.depth for r in gr.reach(e, s, 6, direction).collect()} == want
    assert (7, 7) in want and want[7, 7] == 1
    both = gr.reach(e, s, 6, "both").collect()
    assert all(r.seed != r.node for r in both) and len({(r.seed, r.node) for r in both}) == len(both)
    kept = gr.reach(e, s, 6, keep_seeds=True).collect()
    assert sum(r.depth == 0 for r in kept) == 12 and len({(r.seed, r.node) for r in kept}) == len(kept)


def test_graph_edges(spark):
    e, s = frames(spark, [(1, 2)], [1])
    none = e.limit(0)
    for f in (lambda a, b: gr.reach(a, b, 3), lambda a, b: gr.trails(a, b, 3), lambda a, b: gr.trails(a, b, 3, 5), gr.roots):
        assert f(none, s).count() == 0 and f(e, s.limit(0)).count() == 0
    assert gr.trails(e, s, 3).columns == gr.trails(none, s, 3).columns == ["seed", "node", "depth", "via"]
    rows, flag = gr.nearest_paths(e, s, 3, 1)
    assert [r.file for r in rows.collect()] == [2] and flag.first().truncated
    assert gr.timeline(none, s).collect()[0].generation == 0


# ---- vectors --------------------------------------------------------------------------------------------------------


def vectors(spark, rng, n=400, dims=12):
    x = rng.normal(size=(n, dims)) + rng.integers(0, 3, (n, 1)) * 2
    rows = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(n, x[5].tolist(), "z"), (n + 1, x[5].tolist(), "z")]
    odd = [(n + 2, None, "z"), (n + 3, [0.0] * dims, "z"), (n + 4, [1.0], "z"), (n + 5, [None, *[1.0] * (dims - 1)], "z"), (n + 6, [float("nan")] * dims, "z")]
    return spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<double>, score string").repartition(3), np.array([r[1] for r in rows])


def brute(x, asked, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = np.round(unit[asked] @ unit.T, 9)
    return {(int(q), r + 1): int(i) for q, row in zip(asked, scores, strict=True) for r, i in enumerate(np.lexsort((np.arange(len(x)), -row))[:k])}


def test_exact_and_probed_search(spark, monkeypatch):
    v, x = vectors(spark, np.random.default_rng(3))
    asked = list(range(0, 402, 20))
    q = v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    want = brute(x, asked, 7)
    for block in (ann.BLOCK, 500):
        monkeypatch.setattr(ann, "BLOCK", block)
        assert {(r.query_id, r["rank"]): r.vec_id for r in ann.exact_topk(v, q, 7).collect()} == want
    index = ann.build(v, ann.learn(v, lists=9, parts=4))
    assert sum(index.sizes.values()) == 402
    for rows, queries in ((ann.ROWS, ann.QUERIES), (11, 3)):  # pieces of lists and queries
        monkeypatch.setattr(ann, "ROWS", rows)
        monkeypatch.setattr(ann, "QUERIES", queries)
        assert {(r.query_id, r["rank"]): r.vec_id for r in ann.search(index, v, q, 7, probes=9, candidates=500).collect()} == want
    assert ann.search(index, v, q.limit(0)).count() == 0 and ann.exact_topk(v, q.limit(0)).count() == 0
    assert ann.search(index, v.limit(0), q).count() == 0 and ann.exact_topk(v.limit(0), q).count() == 0
    with pytest.raises(ValueError, match="no vectors"):
        ann.learn(v.limit(0))


def test_recall_of_the_inverted_file(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding")
    q = v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    index, exact = ann.build(v, ann.learn(v)), ann.exact_topk(v, q).persist()
    probes = ann.tune(index, v, q)
    share = ann.recall(ann.search(index, v, q, probes=probes), exact)
    print(f"recall {share:.3f} with {probes} of {len(index.coder.centroids)} lists")
    assert share >= 0.9
    assert ann.recall(exact.limit(0), exact) == 0 and ann.recall(exact, exact.limit(0)) == 1


def test_codes_are_near_their_vectors(spark):
    v, x = vectors(spark, np.random.default_rng(4))
    coder = ann.learn(v, lists=5, parts=6)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = coder.lists(unit)[:, 0]
    codes = coder.codes(unit, near)
    back = coder.centroids[near] + np.concatenate([t[codes[:, i]] for i, t in enumerate(coder.residuals)], axis=1)
    assert np.abs(back - unit).mean() < 0.5 * np.abs(coder.centroids[near] - unit).mean()
    t = coder.tables(unit[:3])
    approx = unit[:3] @ coder.centroids[near].T + np.stack([t[:, i, codes[:, i]] for i in range(6)]).sum(0)
    assert np.allclose(approx, unit[:3] @ back.T)
    assert v.filter(F.col("score") == "z").count() == 407
