"""Work that grew faster than its input: dealt by pairs, held in blocks, counted where it is read."""

import hashlib
import random
import re
import time
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from engram.functions import entities as en
from engram.functions.stem import porter
from engram.operators import ann
from engram.operators import diagnostics as dg
from engram.operators import index as ix
from engram.operators import search as se
from engram.operators import vector as ve


def test_overlaps_are_dealt_by_pairs(spark, monkeypatch):
    rng = random.Random(5)
    span = lambda i: (i % 2 if i % 9 else None, i, a := rng.randrange(40), a + rng.randrange(9))
    rows = [span(i) for i in range(240)] + [(1, 900 + i, 7, 7) for i in range(60)]  # a bin with most of the rows
    s = spark.createDataFrame(rows, "f int, a_id int, a1 int, a2 int").coalesce(1)
    t = s.select("f", F.col("a_id").alias("b_id"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))
    want = sorted((x[1], y[1]) for x in rows for y in rows if x[0] is not None and x[0] == y[0] and x[2] <= y[3] and y[2] <= x[3] and x[1] < y[1])
    for spans, pairs in ((dg.SPANS, dg.PAIRS), (7, 500)):
        monkeypatch.setattr(dg, "SPANS", spans)
        monkeypatch.setattr(dg, "PAIRS", pairs)
        got = dg.overlap_join(s, t, ("a1", "a2"), ("b1", "b2"), "f", width=8).filter("a_id < b_id").select("a_id", "b_id")
        assert sorted(tuple(r) for r in got.collect()) == want
    assert got.rdd.getNumPartitions() > 20  # one file of few rows, many pairs
    none = dg.overlap_join(s.limit(0), t, ("a1", "a2"), ("b1", "b2"), "f")
    assert none.columns == ["f", "a_id", "a1", "a2", "b_id", "b1", "b2"] and none.count() == 0


def test_equal_spans_go_to_their_partners_together(spark, monkeypatch):
    rows = [(1, i, None if i % 7 == 0 else f"n{i % 3}", i % 4, i % 4 + i % 3) for i in range(150)] * 2  # twelve spans
    s = spark.createDataFrame(rows, "f int, id int, name string, a1 int, a2 int")
    t = s.select("f", F.col("a1").alias("b1"), F.col("a2").alias("b2"))  # nothing but spans
    want = sorted(str((x[0], x[1], x[2], x[3], x[4], y[3], y[4])) for x in rows for y in rows if x[3] <= y[4] and y[3] <= x[4])
    for held in (dg.ROWS, 40):
        monkeypatch.setattr(dg, "ROWS", held)
        monkeypatch.setattr(dg, "FEW", 3)
        monkeypatch.setattr(dg, "MANY", 5)
        got = dg.overlap_join(s, t, ("a1", "a2"), ("b1", "b2"), "f", width=2)
        assert got.columns == ["f", "id", "name", "a1", "a2", "b1", "b2"] and sorted(str(tuple(r)) for r in got.collect()) == want


def test_equal_spans_are_not_shuffled_for_each_piece(spark, monkeypatch):
    monkeypatch.setattr(dg, "SPANS", 100)
    s = spark.range(6_000).select(F.lit(1).alias("f"), F.col("id").alias("a_id"), (F.col("id") % 4).alias("a1"), (F.col("id") % 4 + F.col("id") % 3).alias("a2"))
    t = s.select("f", F.col("a_id").alias("b_id"), F.col("a1").alias("b1"), F.col("a2").alias("b2"))

    def written() -> int:
        time.sleep(1)  # figures come a little later
        return spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()

    before = written()
    assert dg.overlap_join(s, t, ("a1", "a2"), ("b1", "b2"), "f", width=8).limit(1).count() == 1
    assert written() - before < 1 << 20  # 60 copies of each row have several times as much


def test_searches_hold_blocks_not_all_pairs(monkeypatch):
    rng = np.random.default_rng(8)
    q, x = rng.normal(size=(3_000, 4)), rng.normal(size=(10_000, 4))
    x[5_000:5_030] = x[0]  # equal scores go by id
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(len(x))[::-1]), pa.array(list(x[::-1]), pa.list_(pa.float64()))], ["id", "embedding"])
    held = SimpleNamespace(value={4: (np.arange(len(q)), unit(q))})
    tracemalloc.start()
    (out,) = ann._nearest(held, 3, ann.ROWS, ann.QUERIES)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # all pairs have 240 MB of scores
    scores = np.round(unit(q[:50]) @ unit(x).T, 9)
    want = np.argsort(-scores, axis=1, kind="stable")[:, :3]
    assert (out.column("id").to_numpy().reshape(-1, 3)[:50] == want).all()


def test_probed_search_keeps_k_rows_a_query_and_task(spark, monkeypatch):
    v = spark.range(400).select(F.col("id").alias("vec_id"), F.array(*(F.sin(F.col("id") * (i + 1) + i) for i in range(6))).alias("embedding"))
    q = v.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    kept = []
    monkeypatch.setattr(ann, "_best", lambda rows, k, own=ann._best: kept.append(rows.count()) or own(rows, k))
    index = ann.build(v, ann.learn(v, lists=5, parts=3))
    monkeypatch.setattr(ann, "PAIRS", 2_000)  # four tasks
    found = ann.search(index, v, q, 10, probes=5, candidates=400).count()
    assert found == 200 and kept == [sum(kept)] and kept[0] <= 20 * 10 * 4  # not all 8,000 pairs


def test_postings_are_counted_where_documents_are_read(spark, monkeypatch):
    texts = ["The cat_1, the CAT\tran", "", None, "naïve  naïve über", "the " * 50 + "end", "running runs ran"]
    docs = spark.createDataFrame([(i, t, "The src") for i, t in enumerate(texts)], "doc_id int, text string, source string")
    monkeypatch.setattr(ix, "WORDS", 7)
    for stemmed in (False, True):
        want = {}
        for i, t in enumerate(texts):
            words = [(w, 1.0) for w in se.words_of(t or "")] + [("the", 2.0), ("src", 2.0)]
            for w, x in words:
                key = (i, len(words), porter(w) if stemmed else w)
                want[key] = want.get(key, 0) + x
        posts = ix.posted(ix._rows(docs, "doc_id", {"text": 1.0, "source": 2.0}, 1), stemmed)
        assert {(r.id, r.len, r.term): r.tf for r in posts.collect()} == want
        assert "Exchange" not in posts._jdf.queryExecution().executedPlan().toString()
    index = ix.build(docs, "doc_id", {"text": 1.0})
    assert {r.id: r.len for r in index.lengths(spark).collect()} == {0: 5, 1: 0, 2: 0, 3: 5, 4: 51, 5: 3}
    assert index.postings(spark).filter("term is null or bucket < 0").count() == 0
    assert ix.bm25(spark, index, "naïve the").count() == 3


def test_hashed_vectors_are_made_in_their_rows(spark, monkeypatch):
    monkeypatch.setattr(ve, "PIECE", 16)  # texts in parts, as grams cross them
    rows = [(1, "One two  two-three; ONE two été x_1"), (2, "a"), (3, None), (4, " - "), (5, "b c d " * 9)]
    shared = [(1, "more of it"), (None, "no id"), (None, "one more")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")

    def want(rows):
        sums = {}
        for i, text in rows:
            w = re.findall(r"[a-z0-9_]+", (text or "").lower())
            for n in (1, 2, 3):
                for at in range(len(w) - n + 1):
                    h = int.from_bytes(hashlib.sha256("_".join(w[at : at + n]).encode()).digest()[:4], "big", signed=True)
                    sums.setdefault(i, Counter())[abs(h) % 768] += 1 if h >= 0 else -1
        norm = {i: sum(x * x for x in s.values()) ** 0.5 for i, s in sums.items()}
        return {(i, k): round(x / norm[i], 9) for i, s in sums.items() for k, x in s.items() if x}

    got = ve.hashed(docs, "doc_id", "text")
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.idx): round(r.weight, 9) for r in got.collect()} == want(rows)
    got = ve.hashed(docs.unionByName(spark.createDataFrame(shared, docs.schema)), "doc_id", "text").collect()
    assert {(r.doc_id, r.idx): round(r.weight, 9) for r in got} == want(rows + shared) and len(got) == len(want(rows + shared))
    assert ve.hashed(docs.limit(0), "doc_id", "text").count() == 0


def test_names_are_looked_for_in_their_texts_row(spark, monkeypatch):
    rows = [(i, f"the and the file {i} of the, it's c++{'' if i % 3 else 'x'} the  and") for i in range(60)] + [(None, "the of"), (None, "the file 7"), (7, None), (7, "A.B the of")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    names = ["the", "the and", "the of", "The  and", "the file 7", "file", "file 5 of the, it", "c++", "a.b", "b the", ".b the", "nothing", None, "++", "the file 70"]
    known = spark.createDataFrame([(n,) for n in names], "name string")
    word = lambda n, t: re.search(rf"(?<![a-z0-9_]){re.escape(n.lower())}(?![a-z0-9_])", t.lower())
    want = sorted({(str(i), n.lower()) for i, t in rows for n in names if t and n and n != "++" and word(n, t)})
    found = en.dictionary_mentions(docs, "doc_id", "text", known)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1  # what was found, once each
    for at_most in (en.BROADCAST_BYTES, 0):
        monkeypatch.setattr(en, "BROADCAST_BYTES", at_most)
        got = en.dictionary_mentions(docs, "doc_id", "text", known).collect()
        assert sorted((str(r.doc_id), r.name) for r in got) == want


def test_texts_without_a_patterns_signs_are_not_searched(spark, monkeypatch):
    texts = """Dr. Ada Byron|Mrs Eve|Prof Max Planck|Ann Lee reviewed it|Ada Byron's work|ask @ada_1|Acme Works GmbH.|a big inc|work by blue sky TEAM|the red group
        Use Cloudflare|see lib/x.scss|a/b.yml|x../up/here|tests/unit|__tests__/one|spec/two|index.jsx|load (x)|async function go1|function go2|const f = async (a) => 1|a.bc (d)|useState
        We DECIDED to go|opted to stay|the decision was no way|THEY shall pass|going With you|chose tea over milk|FIXME: that bug|Need to eat|DELETE files|- [x] done|should be ok
        ERROR: bad|IoFault|FAILED to run|at a.b (f.js:1:22)|threw an IoError|Couldn't stop|could not wait|the Concept of time|one two Paradigm
        class Ab|interface Cd|type Ef = 1|extends Gh|implements Ij|MyProps|failed to \\u00a0|failed to   .|nothing here""".replace("\\u00a0", " ")
    rows = [(i, t.strip()) for i, t in enumerate(texts.replace("\n", "|").split("|"))] + [(-1, None), (-2, "")]
    docs = spark.createDataFrame(rows + [(1000, " ; ".join(t for _, t in rows if t))], "id bigint, text string")
    found = lambda: sorted(map(tuple, en.extract(docs, "id", "text").collect()))
    got = found()
    assert set(en.NEEDS) == {p for ps in en.PATTERNS.values() for p in ps}
    for t, ps in en.PATTERNS.items():  # each pattern finds something by itself
        for p in ps:
            assert en.extract(docs.filter("id < 1000"), "id", "text", {t: [p]}).limit(1).count() == 1, (t, p)
    monkeypatch.setattr(en, "NEEDS", {})
    assert got == found()


def test_texts_are_searched_from_their_signs_on(spark, monkeypatch):
    rng = random.Random(9)
    bits = """the we they i Dr. Mr Ada Byron Ann's said fixed Acme Inc GmbH. by from TEAM group company Google a/b.yml src/x lib/ ../up ./q index.ts .ts load ( ) (x) async function go1 const f = => .bc use
        useState decided opted to decision was will should going with chose over TODO: BUG: NOTE: need add FIX delete - [x] [ ] * Error: IoFault Exception failed at a.b (f.js:1:22) threw an cannot could not couldn't concept
        of pattern paradigm Paradigm_x class interface type extends implements Ab MyProps XType @ada_1 é ñandú x́y İo Klm words 7 _""".split()
    ends = [" ", " ", " ", " ", " ", "  ", ".", ". ", "\n", " \n ", ",", "\t", " ", "", "\x0b", "!", "\r\n"]
    texts = ["".join(rng.choice(bits) + rng.choice(ends) for _ in range(rng.choice([3, 9, 30]))) for _ in range(1500)]
    docs = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "")], "id bigint, text string").repartition(4)
    found = lambda: sorted(map(tuple, en.extract(docs, "id", "text").collect()))
    got = found()
    needs = [(en.NEEDS[p], s.encode() if (s := en.BREAKS.get(p, " ")) else None) for ps in en.PATTERNS.values() for p in ps]
    monkeypatch.setattr(en, "NEEDS", {})
    assert got == found() and {r[1] for r in got} == set(en.PATTERNS)
    prose = "Many plain words of one text. " * 500
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array([prose + "It failed to parse", None, prose, ""])], ["id", "__text"])
    rows = [tuple(r.values()) for out in en._searched(needs)(iter([batch])) for r in out.to_pylist()]
    assert [(i, text) for i, _, text in rows] == [(1, "failed to parse")]  # not 15,000 characters for each pattern


def test_texts_are_not_joined(spark, sf):
    from engram.plans import text as tx

    plan = tx.entity_confidence(spark, sf)._jdf.queryExecution().optimizedPlan()
    assert [line.strip(" :+-")[:7] for line in plan.toString().split("\n") if "length(" in line and " AS size#" in line] == ["Project"]
