"""A segmented index equals one made at once, after every update and merge; its writes are those of the changes."""

import random

import pytest

from engram.operators import index as ix
from engram.operators import segments as sg
from engram.sources.store import Conflict, Store


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 9) for i, t in docs.items()], "doc_id bigint, text string, len int")


def check(spark, index, docs, path):
    """Frequencies, figures and scores as of an index of the documents that there are."""
    whole = ix.build(frame(spark, docs), "doc_id", {"text": 1.0}, path=path)
    want = sorted((r.id, r.len, r.term, r.tf) for r in whole.postings(spark).drop("bucket").select("id", "len", "term", "tf").collect())
    assert sorted(map(tuple, index.postings(spark).collect())) == want
    if docs:
        assert index.figures(spark) == pytest.approx(whole.figures(spark))
        for q in ("w1 w2", "w3"):
            a, b = ({r.doc_id: round(r.score, 9) for r in ix.bm25(spark, x, q).collect()} for x in (index, whole))
            assert a == b


def test_updates_and_merges(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(6)))
    docs = {i: text() for i in range(30)} | {30: None}
    store = Store(spark, f"file://{tmp_path}/s")
    index = sg.create(store, frame(spark, docs), "doc_id")
    check(spark, index, docs, f"{tmp_path}/0")
    pinned, before = index.pinned(), dict(docs)
    changed = {3: text(), 4: "w1 w1 w2", 31: text(), None: "w1"}
    index.update(frame(spark, changed))
    docs |= {k: v for k, v in changed.items() if k is not None}
    check(spark, index, docs, f"{tmp_path}/1")
    check(spark, pinned, before, f"{tmp_path}/2")  # a reader keeps to its version
    index.update(gone=spark.createDataFrame([(4,), (5,), (99,), (None,)], "id bigint"))
    docs = {k: v for k, v in docs.items() if k not in (4, 5)}
    # 6 is among the changed and the gone: it is changed
    index.update(frame(spark, {5: "w3 back", 6: "w1 six"}), spark.createDataFrame([(6,), (7,)], "id bigint"))
    docs |= {5: "w3 back", 6: "w1 six"}
    del docs[7]
    check(spark, index, docs, f"{tmp_path}/5")
    index.update(frame(spark, {6: "w2 w3"}))
    docs[6] = "w2 w3"
    check(spark, index, docs, f"{tmp_path}/3")
    parts = len(store.at().parts("postings"))
    index.merge(2)
    assert len(store.at().parts("postings")) < parts
    check(spark, index, docs, f"{tmp_path}/4")


def test_an_update_writes_its_changes(spark, tmp_path):
    docs = {i: " ".join(f"word{i}x{j}" for j in range(300)) for i in range(200)}
    store = Store(spark, f"file://{tmp_path}/s")
    index = sg.create(store, frame(spark, docs), "doc_id")
    size = lambda: sum(store.size(p) for p in store.at().parts("postings"))
    first = size()
    index.update(frame(spark, {5: "one small text"}))
    assert size() - first < first / 10 and store.at().parts("postings")[0]


def test_feed_is_applied_once(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    index = sg.create(store, frame(spark, {1: "w1", 2: "w2"}), "doc_id")
    kinds = "doc_id bigint, type string, text string, seq bigint"
    feed = spark.createDataFrame([(1, "MEMORY_UPDATED", "w9", 1), (1, "MEMORY_DELETED", None, 2), (2, "MEMORY_DELETED", None, 3), (2, "MEMORY_SAVED", "w3 w3", 4), (3, "MEMORY_SAVED", "w4", 5)], kinds)
    for _ in range(2):  # a batch that is tried again
        sg.apply_changes(index, feed, batch=7)
    check(spark, index, {2: "w3 w3", 3: "w4"}, f"{tmp_path}/0")
    assert store.at().table("figures").count() == 2
    sg.apply_changes(index, feed.limit(0), batch=8)
    check(spark, index, {2: "w3 w3", 3: "w4"}, f"{tmp_path}/1")


def test_updates_at_once(spark, tmp_path, monkeypatch):
    store = Store(spark, f"file://{tmp_path}/s")
    index = sg.create(store, frame(spark, {1: "w1"}), "doc_id")
    own = Store.commit

    def commit(self, *args, **kw):
        monkeypatch.undo()
        index.update(frame(spark, {2: "w2"}))  # another writer comes first
        return own(self, *args, **kw)

    monkeypatch.setattr(Store, "commit", commit)
    with pytest.raises(Conflict):
        index.update(frame(spark, {3: "w3"}))
    check(spark, index, {1: "w1", 2: "w2"}, f"{tmp_path}/0")


def test_empty_index(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    index = sg.create(store, frame(spark, {1: "x"}).limit(0), "doc_id")
    assert index.figures(spark) == (0, 0.0) and ix.bm25(spark, index, "x").count() == 0
    index.update(frame(spark, {1: "x"}))
    check(spark, index, {1: "x"}, f"{tmp_path}/0")
