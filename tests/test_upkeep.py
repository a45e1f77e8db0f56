"""Gates, scores after accesses, facts, mentions and the soak monitor on small tables with nulls, gaps and empty ones."""

import shutil

import pytest
from pyspark.sql import functions as F

from engram.functions import entities as en
from engram.operators import commits as cm
from engram.operators import index as ix
from engram.operators import lifecycle as lc
from engram.operators import scoring as sc
from engram.operators import search as se
from engram.operators.soak import soak


def test_evidence_verdicts(spark):
    rows = [("error", ["source"], False), ("error", None, False), ("error", [], True), ("decision", ["source"], None), ("note", None, False), (None, None, False)]
    df = spark.createDataFrame(rows, "c string, p array<string>, admin boolean")
    got = [tuple(r.v) for r in df.select(sc.evidence_verdict(F.col("c"), F.col("p"), F.col("admin"), ("error",)).alias("v")).collect()]
    said = 'Evidence gate for "{}": missing required metadata fields: {}'.format
    assert got == [(True, None), (False, said("error", "source")), (True, None), (True, said("decision", "rationale")), (True, None), (True, None)]


def test_scores_after_accesses(spark):
    day = 86_400_000
    tracked = spark.createDataFrame([(1, 4, 0, 0.5), (2, 0, 5 * day, 0.25), (3, 1, None, None)], "memory_id bigint, access_count bigint, last_ms bigint, score double")
    reads = spark.createDataFrame([(1, 9 * day), (1, 8 * day), (4, 10 * day), (4, 3 * day)], "memory_id bigint, ms bigint")
    traits = spark.createDataFrame([(1, "high", "decision"), (2, "low", "fact")], "memory_id bigint, priority string, category string")
    got = {r.memory_id: (r.access_count, r.last_ms, r.score) for r in lc.access_scores(tracked, reads, traits, 10 * day).collect()}
    one = lambda p, c, n, d: spark.range(1).select(sc.relevance(F.lit(p), F.lit(c), F.lit(n), F.lit(float(d)))).first()[0]
    assert got[1][:2] == (6, 9 * day) and got[1][2] == pytest.approx(one("high", "decision", 6, 1))
    assert got[4][:2] == (2, 10 * day) and got[4][2] == pytest.approx(one("normal", "note", 2, 0))
    assert got[2] == (0, 5 * day, 0.25) and got[3] == (1, None, None)
    assert lc.access_scores(tracked.limit(0), reads.limit(0), traits, 0).count() == 0


def test_facts(spark):
    rows = [("g", 3, " A  fact "), ("g", 2, "a FACT"), ("g", 1, "other"), ("h", 4, None), (None, 5, "a fact")]
    got = sc.facts(spark.createDataFrame(rows, "source string, memory_id bigint, value string"), "source").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("g", 2, "a FACT", 2), ("g", 1, "other", 1), ("h", 4, None, 1), (None, 5, "a fact", 1)]))


def test_mentions_of_a_table(spark):
    docs = spark.createDataFrame([(1, "We use Foo-Bar and c++ in foo bar."), (2, "foobar foo_bar"), (3, None), (4, "FOO")], "doc_id bigint, text string")
    names = spark.createDataFrame([("foo",), ("Foo",), ("foo bar",), ("foo-bar",), ("c++",), (None,), ("...",), ("bar.",)], "name string")
    got = sorted((r.doc_id, r.name) for r in en.dictionary_mentions(docs, "doc_id", "text", names).collect())
    assert got == [(1, "bar."), (1, "c++"), (1, "foo"), (1, "foo bar"), (1, "foo-bar"), (4, "foo")]
    assert en.dictionary_mentions(docs.limit(0), "doc_id", "text", names).count() == 0 and en.dictionary_mentions(docs, "doc_id", "text", names.limit(0)).count() == 0
    rows = spark.createDataFrame([("p", "technology", "go"), ("p", "pattern", "saga"), ("p", "project", "p"), ("p", "project", "q"), ("p", "project", "q"), (None, "project", "q")], "source string, kind string, name string")
    assert sorted(map(tuple, en.relations(rows, "source").collect())) == [("p", "go", "uses", 1), ("p", "q", "related_to", 2), ("p", "saga", "implements", 1)]


def test_soak(spark):
    hard = {1: 1, 2: 0, 3: 1, 4: 0, 5: 0, 6: 1, 7: 1, 9: 1, 10: 1, 11: 1}  # a day is missing
    soft = {1: 1, 2: 1, 3: 0, 4: 1, 5: None, 6: 1, 7: 1, 9: 0, 10: 0, 11: 1}
    rows = [(d, "h", True, bool(g)) for d, g in hard.items()] + [(d, "s", False, None if g is None else bool(g)) for d, g in soft.items()]
    got = [tuple(r) for r in soak(spark.createDataFrame(rows, "day bigint, gate string, hard boolean, green boolean"), 3, 2, 4).orderBy("day").collect()]
    assert got == [(1, 1, 1, 1, False), (2, 1, 0, 2, False), (3, 1, 1, 2, False), (4, 1, 0, 3, False), (5, 5, 0, 2, False), (6, 5, 1, 2, False), (7, 5, 2, 3, False), (9, 5, 1, 2, False), (10, 5, 2, 1, False), (11, 5, 3, 1, False)]
    clean = soak(spark.createDataFrame([(d, "h", True, True) for d in range(5)], "day bigint, gate string, hard boolean, green boolean"), 3, 2, 4).orderBy("day").collect()
    assert [(r.streak, r.clean) for r in clean] == [(1, False), (2, False), (3, True), (4, True), (5, True)]
    assert soak(spark.createDataFrame([], "day bigint, gate string, hard boolean, green boolean")).count() == 0


def test_weights_of_a_query():
    assert se.resolved_weights("some text") == se.PROFILES["general"]
    asked = se.resolved_weights("what caused the crash")
    assert asked["causal"] == pytest.approx(0.45 / 1.15) and sum(asked.values()) == pytest.approx(1)
    assert se.resolved_weights("some text", profile="error_investigation", direction="effect") == asked
    assert se.resolved_weights("why", {"keyword": 1.0})["keyword"] == 1.0 and "causal" not in se.resolved_weights("because")


def test_hybrid_edges(spark):
    a = spark.createDataFrame([(i, 1.0 - i / 10, "x") for i in range(6)], "doc_id bigint, score double, rank string")
    none = a.limit(0)
    got = se.hybrid("text", {"keyword": a, "semantic": none, "code": a}, limit=2).collect()
    assert [(r.doc_id, r["rank"]) for r in got] == [(0, 1), (1, 2)]
    with pytest.raises(ValueError, match="no list"):
        se.hybrid("text", {"code": a})
    assert se.hybrid("text", {"keyword": none}).count() == 0 and se.hybrid("text", {"keyword": a}, threshold=0.99, limit=3).count() == 0
    ages = spark.createDataFrame([(1, 0.0), (5, 0.0)], "doc_id bigint, days double")
    assert se.hybrid("text", {"keyword": a}, ages=ages, limit=3).first().doc_id == 1
    texts = spark.createDataFrame([(0, "b"), (1, "ccc"), (2, None)], "doc_id bigint, text string")
    order = [r.doc_id for r in se.hybrid("text", {"keyword": a}, texts=texts, rerank=lambda q, ts: [float(len(t)) for t in ts], limit=2).collect()]
    assert order == [1, 0]
    assert [r.doc_id for r in se.hybrid("text", {"keyword": a}, texts=texts, rerank=lambda q, ts: None, limit=2).collect()] == [0, 1]


def test_texts_come_to_the_short_list(spark, monkeypatch):
    lists = {"keyword": spark.range(300).select(F.col("id").alias("doc_id"), (1 / (F.col("id") + 1)).alias("score"))}
    texts = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text")).unionByName(spark.createDataFrame([(3, "y" * 90)], "doc_id bigint, text string"))
    ages = spark.range(400).select(F.col("id").alias("doc_id"), F.lit(1.0).alias("days"))
    plans = {}
    monkeypatch.setattr(se, "materialize", lambda df, name, own=se.materialize: plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}) or own(df, name))
    found = se.hybrid("text", lists, ages=ages, texts=texts, rerank=lambda q, ts: [float(len(t)) for t in ts], limit=4)
    assert [(r.doc_id, r.score) for r in found.collect()] == [(3, 90.0), (7, 7.0), (6, 6.0), (5, 5.0)]
    assert "Range (0, 300" not in found._jdf.queryExecution().optimizedPlan().toString()  # the lists are read once
    for name, table in (("texts", "Range (0, 500"), ("short", "Range (0, 400")):  # the short list goes to the table, not the table to a shuffle
        assert table in plans[name] and "Join LeftSemi" in plans[name].split(table)[0] and "strategy=broadcast" in plans[name]


def test_hybrid_with_an_empty_text(spark, sf, tmp_path):
    import duckdb

    from engram import registry

    con = duckdb.connect()
    empty = "REPLACE (CASE WHEN doc_id IN (SELECT min(doc_id) FROM labels WHERE quality = 1) THEN '' ELSE text END AS text)"
    for t in ("lineitem", "labels", "embeddings", "events", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * {empty if t == 'documents' else ''} FROM '{sf}/{t}.parquet'")
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    assert con.execute("SELECT count(*) FROM documents WHERE text = ''").fetchone() == (1,)
    for name in ("hybrid_modes", "hybrid_reranked"):
        found = con.execute(registry.oracle_sql()[name])
        columns = [d[0] for d in found.description]
        got = registry.queries()[name](spark, str(tmp_path)).select(*columns).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, found.fetchall()))


def test_an_index_that_was_cleared_away_is_built_again(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ix, "shared_dir", lambda spark: f"file://{tmp_path}")
    spark.createDataFrame([(1, "a thing"), (2, "a b")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    own = lambda: ix.of_table(spark, f"{tmp_path}/documents.parquet", "doc_id", {"text": 1.0})
    found = lambda: [r.doc_id for r in ix.bm25(spark, own(), "thing").collect()]
    assert found() == [1] and own() == own()
    first = own().path
    for cleared in (f"{first}/figures", own().path):
        shutil.rmtree(cleared.removeprefix("file://"))
        assert found() == [1]
    assert own().path != first


def test_ids_rise_within_a_tick(spark):
    df = spark.createDataFrame([(i, 1000 + (i * 7) % 3) for i in range(60)], "event_id bigint, ms bigint").repartition(4)
    rows = sorted(map(tuple, cm.with_ids(df, "event_id").select("ms", "event_id", "id").collect()))
    assert [r[2] for r in rows] == sorted(r[2] for r in rows) and len({r[2] for r in rows}) == 60
    assert [int(r[2].split("-")[2][1:], 16) for r in rows] == [*range(20)] * 3 and cm.with_ids(df.limit(0), "event_id").count() == 0
