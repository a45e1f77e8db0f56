"""Ordered digests against hashlib: null groups and lines, repeated lines, groups over many batches."""

import hashlib
import random

from engram.operators import digests as dg
from engram.operators import graph as gr


def test_ordered_digests(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice(["x", "é", "y z", "", None]) and str(rng.randrange(99))) for _ in range(400)] + [("n", None), ("n", None)]
    want = {}
    for g, line in rows:
        want.setdefault(g, []).extend([line] if line is not None else [])
    want = {g: hashlib.sha256("".join(x + "|" for x in sorted(v)).encode()).hexdigest() for g, v in want.items()}
    df = spark.createDataFrame([(*r, 1) for r in rows], "grp string, line string, digest int")
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert {r.grp: r.digest for r in dg.ordered_sha256(df, "grp", "line", "|").collect()} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert dg.ordered_sha256(df.limit(0), "grp", "line").count() == 0


def test_corpus_hash_and_freshness(spark):
    files = [("p", "b", "2"), ("p", "a", "1"), ("q", "a", "1")]
    df = spark.createDataFrame(files, "project string, path string, sha256 string")
    got = {r.project: r.corpus_hash for r in dg.corpus_hash(df, "project").collect()}
    assert got == {"p": hashlib.sha256(b"a\t1\nb\t2\n").hexdigest(), "q": hashlib.sha256(b"a\t1\n").hexdigest()}
    assert gr.freshness(got["p"], got["q"]) == "stale" and gr.freshness(got["p"], got["p"]) == "current" and gr.freshness(None, None, False) == "unavailable"
