"""Fixtures with known results for operators whose order or state SQL expresses badly."""

import re

import pytest
from pyspark.sql import functions as F

from engram.functions import entities as en
from engram.functions import text as tx
from engram.functions.stem import porter
from engram.operators import code, graph, hooks, index, lifecycle, memory, projects, scoring, search, state, temporal
from engram.sources import files, transcripts


def test_bm25_scores(spark):
    d = spark.createDataFrame([("c1", "scoring scoring scoring algorithm"), ("c2", "this uses scoring for ranking")], "id string, text string")
    got = {r.id: r.score for r in search.bm25(d, "scoring", "id").collect()}
    assert got["c1"] == pytest.approx(0.312551, abs=1e-6) and got["c2"] == pytest.approx(0.173640, abs=1e-6)
    d = spark.createDataFrame([("c1", "common word rare unique"), ("c2", "common word another"), ("c3", "common word yet another")], "id string, text string")
    assert [(r.id, round(r.score, 6)) for r in search.bm25(d, "rare", "id").collect()] == [("c1", 0.942281)]
    assert search.bm25(d, "", "id").count() == 0 and search.bm25(d.limit(0), "rare", "id").count() == 0


def test_relevance(spark):
    d = spark.createDataFrame([("high", "decision", 4, 10.0), ("normal", "note", 1, 14.0), ("low", "observation", 0, 3.0)], "p string, c string, n int, d double")
    got = [round(r.s, 4) for r in d.select(scoring.relevance(F.col("p"), F.col("c"), F.col("n"), F.col("d")).alias("s")).collect()]
    assert got == pytest.approx([2.5939, 0.6477, 0.3600], abs=2e-4)


@pytest.mark.parametrize(
    ("value", "reason"),
    [("", "empty content"), ("  ", "empty content"), ("TODO", "too short (< 10 chars)"), ("hello world", "generic filler"), ("https://example.com/some/path", "bare URL without context"),
     ("aaaaaaaaaaaaa", "repetitive content"), ("test test test test test", "repetitive content"), ("The database uses port 3003 for connections", None), ("Check the docs at https://example.com/docs for more info", None)],
)
def test_junk(spark, value, reason):
    assert spark.createDataFrame([(value,)], "v string").select(scoring.junk_reason(F.col("v"))).first()[0] == reason


def test_profiles_and_causal_boost():
    assert search.detect_profile("why did we decide today?") == "decision_recall"
    assert search.detect_profile("what happened last week") == "temporal"
    w = search.causal_boost(search.PROFILES["error_investigation"], "why did it crash")
    assert sum(w.values()) == pytest.approx(1) and w["causal"] > 0.3


def test_tokens(spark):
    assert spark.createDataFrame([("foo.bar(baz)",)], "t string").select(tx.tokens(F.col("t"))).first()[0] == ["foo", "bar", "baz"]


def test_glob():
    assert memory.glob_pattern("a*b?.c") == r"^a.*b.\.c$"


def test_admission_is_sequential(spark):
    r = spark.createDataFrame([(1, 1, 60), (1, 2, 50), (1, 3, 40), (1, 4, 1), (2, 1, 100)], "agent bigint, seq bigint, size bigint")
    got = {(x.agent, x.seq): x.admitted for x in state.admit(r, 100, 3).collect()}
    assert got == {(1, 1): True, (1, 2): False, (1, 3): True, (1, 4): False, (2, 1): True}


def test_steps():
    def run(step, rows):
        s, out = None, []
        for r in rows:
            s, y = step(s, r)
            out.append(y)
        return out

    at = [{"ms": m} for m in (0, 10, 40, 60, 75)]
    assert run(state.dedup_step(30), at) == [True, False, True, False, True]
    assert run(state.sliding_step(30), at) == [True, False, True, False, False]
    assert run(state.rate_step(2, 50), at) == [True, True, False, True, True]
    assert run(state.drift_step(10), [{"value": v} for v in (100, 105, 130, 112, 90)]) == [False, False, True, False, True]
    held = [{"ms": m, "holder": h} for m, h in ((0, "a"), (5, "b"), (9, "a"), (20, "b"))]
    assert run(state.lock_step(10), held) == [True, False, True, True]


def test_shortest_path_and_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    pairs = spark.createDataFrame([("a", "c"), ("a", "a"), ("a", "z")], "source string, target string")
    assert [(r.source, r.target, r.via) for r in graph.shortest_paths(e, pairs).collect()] == [("a", "c", ["a", "b", "c"])]
    # edges, not nodes, are used once: the cycle leads back to its start
    assert {(r.node, r.depth) for r in graph.reach(e, spark.createDataFrame([("a",)], "seed string"), 5).collect()} == {("a", 3), ("b", 1), ("c", 2)}


def test_python_structure():
    src = "from .base import (a,\n    b)\nimport json as _j, os\nfrom ..x.y import z\nclass K:\n    def f(self):\n        pass\n    def g(self): pass\ndef h():\n    return 1\n"
    assert code.python_imports("p/q/m.py", src) == [("p/q/base", "a", 1), ("p/q/base", "b", 1), ("json", "json", 3), ("os", "os", 3), ("p/x/y", "z", 4)]
    assert [(k, n, a, b) for k, n, a, b, _ in code.python_symbols(src)] == [("class", "K", 5, 11), ("function", "f", 6, 7), ("function", "g", 8, 8), ("function", "h", 9, 11)]
    assert [k for k, _, _ in code.comment_chunks("a.ts", "x // c\n/* d */ y")] == ["code", "comment", "code", "comment", "code"]
    assert code.script_symbols("export function f(a) {\n  if (a) {}\n}\nconst x = 1;\n")[0][:4] == ("function", "f", 1, 3)


def test_sources(spark, tmp_path):
    (tmp_path / "a.py").write_text("x = 1\n")
    (tmp_path / ".env").write_text("k=v")
    (tmp_path / "bin.dat").write_bytes(b"a\0b")
    assert [r.path.split("/")[-1] for r in files.scan(spark, str(tmp_path)).collect()] == ["a.py"]
    (tmp_path / "t.jsonl").write_text('{"role":"user","content":"hi"}\n{"role":"assistant","content":"no"}\nbroken\n{"type":"human","message":{"content":[{"type":"text","text":"a"},{"type":"text","text":"b"}]}}\n')
    assert sorted(r.text for r in transcripts.read(spark, str(tmp_path / "t.jsonl")).collect()) == ["a\nb", "hi"]


@pytest.mark.parametrize(
    ("word", "stem"),
    [("caresses", "caress"), ("ponies", "poni"), ("ties", "ti"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("sing", "sing"), ("conflated", "conflat"), ("troubled", "troubl"),
     ("sized", "size"), ("hopping", "hop"), ("falling", "fall"), ("hissing", "hiss"), ("failing", "fail"), ("filing", "file"), ("happy", "happi"), ("sky", "sky"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"),
     ("predication", "predic"), ("sensibiliti", "sensibl"), ("triplicate", "triplic"), ("electricity", "electr"), ("hopeful", "hope"), ("goodness", "good"), ("revival", "reviv"), ("adjustment", "adjust"), ("adoption", "adopt"), ("communism", "commun"),
     ("probate", "probat"), ("rate", "rate"), ("cease", "ceas"), ("controll", "control"), ("roll", "roll"), ("is", "is"), ("x86s", "x86s")],
)
def test_porter(word, stem):
    assert porter(word) == stem


def test_index(spark):
    """The stored index against the scan, null and empty texts, clashing columns, updates, stems and phrases."""
    rows = [(1, "The cats sat", "a"), (2, None, "cats"), (3, "", None), (4, "a cat, the cat and a dog", "b"), (5, "nothing here", "c"), (6, "the dog sat on the cat", "tf")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, term string").withColumn("len", F.lit(7))
    made = index.build(d, "doc_id", {"text": 1.0})
    for q in ("cat", "the cat dog", "zebra", "", "sat sat the"):
        got = {r.doc_id: r.score for r in index.bm25(spark, made, q, multiset=True).collect()}
        want = {r.doc_id: r.score for r in search.bm25(d.fillna({"text": ""}), q, multiset=True).collect()}
        assert got == pytest.approx(want)
    assert {r.doc_id for r in index.and_search(spark, made, "dog cat").collect()} == {4, 6}
    assert {r.doc_id for r in index.or_search(spark, made, d, '"dog sat" nothing', F.col("text")).collect()} == {5, 6}
    assert {r.doc_id for r in index.or_search(spark, made, d, '"sat dog"', F.col("text")).collect()} == set()
    stems = index.build(d, "doc_id", {"text": 1.0, "term": 2.0}, stemmed=True)
    assert {r.doc_id for r in index.bm25(spark, stems, "cats").collect()} == {1, 2, 4, 6}
    again = index.reindex(made, d.filter("doc_id = 5").withColumn("text", F.lit("cat")), {"text": 1.0}, spark.createDataFrame([(6,)], "id bigint"))
    assert {r.doc_id for r in index.bm25(spark, again, "cat").collect()} == {4, 5} and again.figures(spark)[0] == 5
    nothing = index.build(d.limit(0), "doc_id", {"text": 1.0})
    assert index.bm25(spark, nothing, "cat").count() == 0
    said = d.filter(index.evidence(F.col("term"), F.col("text"), "dog cat")).select("doc_id")
    assert {r.doc_id for r in said.collect()} == {4, 6}


def test_stemmed_search_by_a_loop(spark, sf):
    from engram.plans import retrieval

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()
    stems = lambda t: {porter(w) for w in search.words_of(t or "")}
    for q in ("things under", "the and"):
        found = index.and_search(spark, retrieval._index(spark, sf, {"text": 1.0, "source": 2.0}, stemmed=True), q)
        assert {r.doc_id for r in found.collect()} == {r.doc_id for r in docs if stems(q) <= stems(r.text) | stems(r.source)}


def test_misses(spark):
    docs = spark.createDataFrame([("aa one two three four five six bb",), ("xx one two three  four five six yy",), (None,), ("short text",)], "text string")
    items = spark.createDataFrame([(1, "a one two three four five six b"), (2, "one two three five four six seven"), (3, "ort te"), (4, "none"), (5, None), (6, ""), (7, "x one two three  four five six y")], "item_id int, text string")
    assert {r.item_id for r in search.misses(docs, items, "item_id").collect()} == {2, 4, 5}
    assert search.misses(docs.limit(0), items, "item_id").count() == 7 and search.misses(docs, items.limit(0), "item_id").count() == 0


def test_sequential_with_null_keys(spark):
    """A null key is one key: a lock of it isn't given twice; big numbers stay whole."""
    big = 2**53 + 1
    rows = [(None, 1, 0, big), (None, 2, 10, big + 1), (7, 3, 0, big), (None, 4, 3_600_000, big + 1), (7, 5, 5, big)]
    d = spark.createDataFrame(rows, "key bigint, event_id bigint, ms bigint, holder bigint")
    got = {r.event_id: (r.accepted, r.holder) for r in state.sequential(d, "key", "event_id", state.lock_step(3_600_000)).collect()}
    assert got == {1: (True, big), 2: (False, big + 1), 3: (True, big), 4: (True, big + 1), 5: (True, big)}
    assert state.sequential(d.limit(0), "key", "event_id", state.lock_step(1)).count() == 0
    a = spark.createDataFrame([("x", 1, 5), ("x", 2, None), ("x", 3, 6), (None, 1, 9)], "agent string, seq int, size int")
    assert sorted((str(r.agent), r.seq, r.admitted) for r in state.admit(a, 10, 2).collect()) == [("None", 1, True), ("x", 1, True), ("x", 2, True), ("x", 3, False)]


def test_hydrate_partial_edges(spark):
    rows = [(1, "s", "k", "MEMORY_SAVED", "a", {"x": "1", "y": "1"}), (2, "s", "k", "MEMORY_UPDATED", None, {"y": "2"}), (3, "s", "k", "MEMORY_UPDATED", "b", None), (4, "s", "gone", "MEMORY_SAVED", "z", None), (5, "s", "gone", "MEMORY_DELETED", None, None),
            (6, "s", "again", "MEMORY_DELETED", None, None), (7, "s", "again", "MEMORY_SAVED", None, None), (8, "s", "never", "MEMORY_UPDATED", "u", None)]
    d = spark.createDataFrame(rows, "event_id int, session_id string, key string, event_type string, v string, metadata map<string, string>")
    got = {r.key: (r.v, r.metadata, r.last_event_id) for r in lifecycle.hydrate_partial(d, ["v"]).collect()}
    assert got == {"k": ("b", {"x": "1", "y": "2"}, 3), "again": (None, None, 7)}
    assert lifecycle.hydrate_partial(d.limit(0), ["v"]).count() == 0


def test_inventory_allows_known_columns(spark):
    p = spark.createDataFrame([("r1", "b", 1), ("r2", "a", 2)], "root string, name string, files int")
    assert [r.name for r in projects.inventory(p, "name").collect()] == ["a", "b"]
    with pytest.raises(ValueError, match="can't sort"):
        projects.inventory(p, "files; drop")


def test_hooks_without_a_service(spark):
    d = spark.createDataFrame([(1, "aa", 0.5), (2, "b", 0.9), (3, None, 0.1)], "doc_id int, text string, score double")
    assert [r.doc_id for r in hooks.reranked(d, "q").orderBy("rank").collect()] == [2, 1, 3]
    assert [r.doc_id for r in hooks.reranked(d, "q", lambda q, ts: None).orderBy("rank").collect()] == [2, 1, 3]
    assert [r.doc_id for r in hooks.reranked(d, "q", lambda q, ts: [float(len(t)) for t in ts]).orderBy("rank").collect()] == [1, 2, 3]
    rows, cache = hooks.embedded(d, lambda ts: [[1.0] for _ in ts])
    assert rows.filter("embedding is not null").count() == 2 and hooks.embedded(d, lambda ts: 1 / 0, cache)[0].count() == 3
    with pytest.raises(Exception, match="one result for each"):
        hooks.map_texts(d, lambda ts: [], "string").collect()


def test_alerts_escalate():
    step, state_, out = lifecycle.escalate_step(100), None, []
    for ms, severity in ((0, "warning"), (10, "warning"), (20, "critical"), (30, "critical"), (40, "warning"), (139, "warning"), (140, "warning")):
        state_, ok = step(state_, {"ms": ms, "severity": severity})
        out.append(ok)
    assert out == [True, False, True, False, True, False, True]


def test_versions_close_and_open(spark):
    h = spark.createDataFrame([("a", 1, 5, 9, "x"), ("a", 2, 9, None, "y"), ("b", 1, 3, None, "z")], "e string, version int, valid_from bigint, valid_to bigint, v string")
    new = spark.createDataFrame([("a", "n"), ("c", "m")], "e string, v string")
    got = sorted(tuple(r) for r in temporal.store_version(h, new, "e", 20).select("e", "version", "valid_from", F.coalesce("valid_to", F.lit(-1)), "v").collect())
    assert got == [("a", 1, 5, 9, "x"), ("a", 2, 9, 20, "y"), ("a", 3, 20, -1, "n"), ("b", 1, 3, -1, "z"), ("c", 1, 20, -1, "m")]
    assert temporal.invalidate(h, new.limit(0), "e", 20).exceptAll(h).count() == 0


def test_shared_folder_is_told_on_a_cluster(spark, monkeypatch):
    from engram import session

    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"
        getConf = lambda self: Conf()
        _jsc = spark.sparkContext._jsc

    class Session:
        sparkContext, conf = Context(), Conf()

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(RuntimeError, match="checkpoint"):
            session.shared_dir(Session())


#: The word-run patterns as single expressions, which overflow the JVM's stack on long texts.
RUNS = {
    "ORGANIZATION": [
        r"(?i)\b(?:at|by|from|with|for)\s+([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*)\b(?=\s+(?:team|company|organization|group|department))",
        r"(?i)\bthe\s+([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*)\s+(?:team|group|company|organization)\b",
    ],
    "CONCEPT": [r"(?i)\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*)\s+(?:pattern|principle|approach|methodology|architecture|paradigm)\b"],
}


def test_entity_runs_equal_plain_patterns(spark):
    texts = [
        "from Core Data team and the Search Group, with x team", "by Blue Company1 and the team", "the the team group", "for Acme  team teams, at Zed department",
        "a layered pattern and hexagonal pattern_x; clean architecture approach", "Event pattern2 Saga Pattern", "the a pattern", "pattern", "", "x1foo bar paradigm",
    ]
    own = {"ORGANIZATION": [en.PATTERNS["ORGANIZATION"][1], en.PATTERNS["ORGANIZATION"][3]], "CONCEPT": [en.PATTERNS["CONCEPT"][1]]}
    got = en.extract(spark.createDataFrame(list(enumerate(texts)), "id int, t string"), "id", "t", own).collect()
    want = set()
    for i, text in enumerate(texts):
        for kind, patterns in RUNS.items():
            for m in (m for p in patterns for m in re.finditer(p, text, re.ASCII)):
                name = m.group(1).strip()
                if len(name) >= (3 if kind == "ORGANIZATION" else 2) and name.lower() not in en.COMMON:
                    want.add((i, kind, re.sub(r"(?i)^(?:the|a|an)\s+", "", name).lower() if kind == "ORGANIZATION" else name.lower()))
    assert {(r.id, r.type, r.name.lower()) for r in got} == want and len(want) > 8


def test_entity_names_and_confidence(spark):
    long = "plain words of a very long text " * 20_000
    rows = [(1, "Dr. Jane Doe fixed IoError; decided to use Redis."), (2, None), (3, ""), (4, long + "the repository pattern"), (5, "const f = (x) => x"), (1, "@al and @Al and @bo")]
    d = spark.createDataFrame(rows, "id int, t string")
    got = {(r.id, r.type, r.name): round(r.confidence, 4) for r in en.extract(d, "id", "t").collect()}
    assert got[1, "PERSON", "Jane Doe"] == 0.75 and got[1, "ERROR", "IoError"] == 0.6667 and got[1, "DECISION", "use Redis"] == 0.7
    # a name of two letters is no person; the first group of an arrow function is its keyword
    assert not any(n in ("al", "Al", "bo") for _, _, n in got) and (5, "CODE_FUNCTION", "const") in got
    assert not any(i in (2, 3) for i, _, _ in got) and sum(i == 4 and t == "CONCEPT" for i, t, _ in got) == 1
    up = {(r.type, r.name): r.confidence for r in en.extract(d, "id", "t", key=F.lit("Error log"), category=F.lit("Technical")).collect()}
    assert up["ERROR", "IoError"] == pytest.approx(0.8) and up["PERSON", "Jane Doe"] == 0.75 and up["CODE_FUNCTION", "const"] == pytest.approx(0.8)
    over = spark.createDataFrame([(0, 10), (1, 1000), (2, 100), (50, 100), (1, None)], "n int, length int").select(en.overall_confidence(F.col("n"), F.col("length")).alias("c"))
    assert [round(r.c, 4) for r in over.collect()] == [0.0, 0.08, 0.9, 0.5, 0.0]
    assert en.extract(d.filter("id > 9"), "id", "t").count() == 0
