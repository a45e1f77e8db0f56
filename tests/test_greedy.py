"""Greedy runs against loops: ties, null keys, hot keys, long chains, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from engram import session
from engram.operators import greedy as gd
from engram.operators import state as st


def test_running_sums(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i bigint, x bigint")
    want, sums = {}, {}
    for k, i, x in rows:
        n, s = sums.get(k, (0, 0))
        sums[k] = (n + 1, s + x)
        want[i] = sums[k]
    assert {r.i: (r.n, r.s) for r in gd.running(df, "k", ["i"], n=F.lit(1), s=F.col("x")).collect()} == want
    assert gd.running(df.limit(0), "k", ["i"], n=F.lit(1)).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_acceptance_and_rates(spark, hot):
    """One key has nine of ten rows, in chains of hundreds; equal times go by id; a null key is a key."""
    rng = random.Random(2)
    rows = [("h" if hot and i % 10 else rng.choice(["a", "b", None]), i, rng.randrange(40) * 10 + i // 2) for i in range(600)]
    df = spark.createDataFrame([(*r, True) for r in rows], "k string, event_id bigint, ms bigint, accepted boolean").repartition(3)
    order = lambda r: (str(r.k), r.ms, r.event_id)
    for got, step in (
        (gd.accepted(df.drop("accepted"), "k", 15), st.dedup_step(15)),
        (gd.accepted(df.drop("accepted"), "k", 0), st.dedup_step(0)),
        (gd.rate_limited(df.drop("accepted"), "k", 2, 25), st.rate_step(2, 25)),
    ):
        want = st.sequential(df.drop("accepted"), "k", ["ms", "event_id"], step)
        assert sorted(map(tuple, sorted(got.collect(), key=order)), key=str) == sorted(map(tuple, sorted(want.collect(), key=order)), key=str)
    assert gd.accepted(df.limit(0).drop("accepted"), "k", 5).count() == 0 and gd.rate_limited(df.limit(0).drop("accepted"), "k", 1, 5).count() == 0


def parts(text, limit, overlap):
    lines, start, out = text.split("\n"), 0, []
    while start < len(lines):
        end = start + 1
        while end < len(lines) and len("\n".join(lines[start : end + 1])) <= limit:
            end += 1
        a, b = max(0, start - overlap) if out else 0, min(len(lines), end + overlap)
        out.append((len(out) + 1, a + 1, b, "\n".join(lines[a:b])))
        start = end
    return out


def test_packed_lines(spark):
    rng = random.Random(3)
    texts = ["", "\n", "one", "a\n\n\nb", "x" * 50, "x" * 50 + "\n" + "y" * 50, "\n".join("z" * rng.randrange(25) for _ in range(200)), "é😀" * 9 + "\n" + "é" * 21, "\n" * 100]
    df = spark.createDataFrame([*[(i, t, 1) for i, t in enumerate(texts)], (None, "a", 1), (99, None, 1)], "id bigint, content string, part int")
    got = sorted((r.path, r.part, r.first_line, r.last_line, r.content) for r in gd.packed_lines(df, "id", "content", 40, 2).collect())
    assert got == sorted((i, *p) for i, t in enumerate(texts) for p in parts(t, 40, 2))
    assert gd.packed_lines(df.limit(0), "id", "content").count() == 0
    long = spark.createDataFrame([("f", "line of text\n" * 20_000)], "file_path string, content string")
    rows = gd.packed_lines(long).orderBy("part").collect()
    assert [(r.first_line, r.last_line) for r in rows[:2]] == [(1, 2463), (2460, 4924)] and rows[-1].last_line == 20_001


def test_ranges_and_joins_are_dealt_by_rows(spark, monkeypatch):
    """A range has about ROWS rows however many there are; rows are broadcast by their own size, not that of their files."""
    rng = random.Random(4)
    df = spark.createDataFrame([(rng.choice(["a", None]), i, rng.randrange(4000)) for i in range(800)], "k string, event_id bigint, ms bigint")
    seen, plans, own = [], [], gd.materialize

    def written(rows, name):
        out = own(rows, name)
        if name == "ranged":
            seen.append(out.groupBy("_range").count().agg(F.max("count")).first()[0])
        elif name in ("jump", "marked"):
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(gd, "materialize", written)
    monkeypatch.setattr(gd, "ROWS", 25, raising=False)
    monkeypatch.setattr(session, "BROADCAST_BYTES", 0)
    order = lambda r: (str(r.k), r.ms, r.event_id)
    got = gd.accepted(df, "k", 90)
    want = st.sequential(df.withColumn("accepted", F.lit(True)).drop("accepted"), "k", ["ms", "event_id"], st.dedup_step(90))
    assert sorted(map(tuple, sorted(got.collect(), key=order)), key=str) == sorted(map(tuple, sorted(want.collect(), key=order)), key=str)
    assert len(seen) == 2 and max(seen) <= 75  # not 400, a fourth of values and bounds
    assert len(plans) > 8 and not any("Broadcast" in p for p in plans[2:])
    monkeypatch.undo()
    wide = own(spark.createDataFrame([(("x" * 900,), i) for i in range(9)], "k struct<k: string>, pos bigint"), "wide")
    monkeypatch.setattr(session, "BROADCAST_BYTES", 8_000)
    assert session.broadcast_if_small(wide) is wide  # what is in a struct counts
