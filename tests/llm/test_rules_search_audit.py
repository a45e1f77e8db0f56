"""Risk-controlled rules, ranked search and the filter audit against brute force and their SQL; and their edge cases."""

import math
import random
import re
from collections import Counter
from fractions import Fraction
from itertools import permutations

import duckdb
import numpy as np
import pytest

from engram.llm import audit, common, lexical, queries, risk

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, part string, n int, rank int, stratum string"
LABELS = "doc_id bigint, quality int, toxic int"


def made_docs(seed=3):
    """Texts that pass and fail each filter, copies, null ids, null texts and sources, repeated rows."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["é", "日本", "x\x1cy"]
    texts = [None, "", " \t\n\x0b\f\r", "a", "A B C", "price $5", "one\ttwo\x0bthree\rfour", "\x00nul \x7f del"]
    texts += [" ".join(rng.choices(words, k=rng.choice((20, 150, 260)))) for _ in range(12)]
    texts += [" ".join(rng.choices(words[:9], k=240)) + rng.choice(("", " #", " ALL CAPITALS HERE OF COURSE SOMETHING")) for _ in range(8)]
    texts += ["same line here\n" * 9 + " ".join(rng.choices(words, k=70)), "*** ### $$$ " * 30 + "word " * 5]
    docs = [(i, t, ("en", "fr", None, "")[i % 4], ("s1", "s2", "", None)[i % 4 if i % 3 else 0]) for i, t in enumerate(texts)]
    docs += [(100 + i, rng.choice(texts), rng.choice(("en", "fr")), rng.choice(("s1", "s2"))) for i in range(40)]
    docs += [(None, rng.choice(texts), None, "s1") for _ in range(15)] + docs[5:9] + docs[5:7] + [(5, "another text of id 5", "en", "s2")]
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(i, t, lang, s, 0, 9.9, "x", 1, 2, "k") for i, t, lang, s in docs], KINDS).repartition(3)


LABELLED = [(i, i % 3 != 0, i % 5 == 0) for i in range(0, 140, 2)] + [(4, 0, 1), (None, 1, 1), (6, None, None)]
LABEL_ROWS = [(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in LABELLED]


# ---- the audit ------------------------------------------------------------------------------------------------------


def brute_audit(docs, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[j] == 1} for j in (0, 1))
    first = {}
    for i, t, *_ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    out = {}
    for part in {s or "" for *_, s in docs}:
        rows = []
        for i, t, _, s in docs:
            if (s or "") == part:
                t = t or ""
                w = WORD.findall(t)
                fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
                rows.append((fails, i in good, i in toxic))
        total = Counter()
        for order in permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                removed = [r for r in left if r[0][f]]
                redundant = sum(r[0][f] for r in rows) - len(removed)
                left = [r for r in left if not r[0][f]]
                unique = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                out[part, "".join(order), step] = (len(left), len(removed), redundant, unique, sum(r[1] for r in removed), sum(r[2] for r in removed))
                total[f] += len(removed)
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step] += (total[f],)
    return out


@pytest.mark.parametrize("limit", [1 << 24, 0])
def test_audit_by_brute_force(spark, monkeypatch, limit):
    """Without broadcasts the copies' least ids are joined by hot keys and by a shuffle."""
    monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(common, "HOT", 100_000 if limit else 3)
    docs = made_docs()
    got = audit.filter_audit(frame(spark, docs), spark.createDataFrame(LABEL_ROWS, LABELS)).collect()
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == brute_audit(docs, LABEL_ROWS) and len(got) == 3 * 600


def test_audit_edges(spark):
    labels = spark.createDataFrame(LABEL_ROWS, LABELS)
    assert audit.filter_audit(frame(spark, [(1, "a", "en", "s")]).limit(0), labels).count() == 0
    one = audit.filter_audit(frame(spark, [(None, None, None, None)] * 3), labels.limit(0)).filter("filter_order = 'ABCDE'").orderBy("step").collect()
    assert [(r.part, r.kept, r.removed) for r in one] == [("", 0, 3)] + [("", 0, 0)] * 4 and one[0].shapley == 360
    long = "word " * 400_000 + "A" * 100_000
    rows = audit.filter_flags(frame(spark, [(1, long, None, "s"), (2, long, None, "s")]), labels).orderBy("E").collect()
    assert [(r.A, r.B, r.C, r.D, r.E) for r in rows] == [(False, True, True, False, False), (False, True, True, False, True)]


# ---- rules ----------------------------------------------------------------------------------------------------------


def brute_counts(t):
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines), len(lines) - len(set(lines)), len(hit))


@pytest.mark.parametrize("size", [4 << 20, 500])
def test_text_counts(spark, monkeypatch, size):
    monkeypatch.setattr(common, "SLICE_BYTES", size)
    docs = made_docs()
    got = risk.text_counts(frame(spark, docs).select("doc_id", "text", "stratum", "n_chars")).collect()
    key = lambda r: (str(r[0]), r[1:])
    assert sorted(((r.doc_id, *(r[c] for c in risk.COUNTS)) for r in got), key=key) == sorted(((i, *brute_counts(t)) for i, t, *_ in docs), key=key)
    text = "a b c " * 300_000 + "\nx\nx\n"
    assert tuple(risk.text_counts(frame(spark, [(1, text, None, None)]).select("doc_id", "text")).first())[1:] == (900_002, 900_002, 0, 3, 1, 900_000)


def test_exact_binomial():
    for n, p in ((1, Fraction(1, 3)), (12, Fraction(1, 50)), (40, Fraction(1, 2)), (300, Fraction(1, 25))):
        for k in (0, 1, 3, n // 2, n - 1, n):
            if 0 <= k <= n:
                want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
                assert risk.binomial_cdf(k, n, float(p)) == pytest.approx(float(want), rel=1e-9)
                if k < n:
                    u = risk.upper_bound(k, n, 0.01)
                    assert risk.binomial_cdf(k, n, u) == pytest.approx(0.01, rel=1e-6)
    assert risk.binomial_cdf(20_000_000, 1_000_000_000, 0.02) == pytest.approx(0.5, abs=1e-3)


def test_cutoffs_are_a_fixed_sequence():
    rule = risk.Rule("r", "n_symbols", "n_words", 0.05, (9, 8, 7, 6))
    # the third place fails its test, so the fourth isn't looked at, whatever it would catch
    assert risk.choose(rule, [0, 0, 90, 0, 110], [1, 4, 0, 500, 3], 0.01) == (8, 0, 5)
    assert risk.choose(rule, [0, 1, 0, 0, 399], [2, 0, 0, 0, 3], 0.01) == (9, 0, 2)  # the second has fewer bad ones, less good ones
    assert risk.choose(rule, [0, 0, 0, 0, 30], [9, 0, 0, 0, 0], 0.01) == (None, 0, 0)  # 30 don't prove it
    assert risk.choose(rule, [0] * 5, [9] * 5, 0.01) == (None, 0, 0)


def test_false_rejection_is_limited():
    """Over many draws of labelled documents, cutoffs whose true rate is over the share are chosen in at most delta of them."""
    rng, rule, bad = np.random.default_rng(5), risk.Rule("r", "n_symbols", "n_words", 0.05, (3, 2, 1)), 0
    for _ in range(2000):
        seen = rng.multinomial(300, [0.01, 0.01, 0.05, 0.93])  # true rates 0.01, 0.02, 0.07
        bad += risk.choose(rule, seen.tolist(), [1, 1, 400, 0], 0.05)[0] == 1
    assert bad / 2000 <= 0.05


def test_judge_edges(spark):
    docs, labels = made_docs(), spark.createDataFrame(LABEL_ROWS, LABELS)
    got = risk.judge(frame(spark, docs), labels).collect()
    assert len(got) == len(docs) and {r.stratum for r in got} == {"en", "fr", None, ""}
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and r.kept == (not r.base_failed and r.failed == "")
    assert all(r.failed == "" for r in risk.judge(frame(spark, docs), labels.limit(0)).collect())
    assert risk.judge(frame(spark, docs).limit(0), labels).count() == 0


def test_strata_have_their_own_cutoffs(spark, monkeypatch):
    """Symbols mark bad documents in one stratum and are usual in good ones of the other; also where no side is broadcast."""
    plain, marked = " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}*" for i in range(60))
    rows = [(i, plain if i % 2 else marked, "aa", "s") for i in range(800)] + [(1000 + i, marked, "bb", "s") for i in range(400)]
    labels = spark.createDataFrame([(i, int(i % 2 or i >= 1000), 0) for i, *_ in rows], LABELS)
    for limit in (1 << 24, 0):
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(common, "HOT", 100_000 if limit else 500)
        got = risk.judge(frame(spark, rows), labels).collect()
        assert {(r.stratum, r.kept, r.failed) for r in got} == {("aa", True, ""), ("aa", False, "symbols"), ("bb", True, "")} and len(got) == 1200


# ---- search ---------------------------------------------------------------------------------------------------------


def brute_search(docs, items, k=10, every=False):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
    bags = [(i, Counter(terms(t))) for i, t, *_ in docs]
    n, length = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        asked, scored = set(terms(text)) & set(df), []
        for i, bag in bags:
            if every and not set(terms(text)) <= set(bag):
                continue
            m = 10 + 90 * sum(bag.values()) * n // length if length else 0
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 8 * m)) for t in asked if bag[t])
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


ITEMS = [(1, "w1 w2 W3 w250 é 日本 unknown"), (2, None), (3, "..!"), (4, "w5"), (4, "w5"), (None, "w7 w8 w7"), (6, "nothing of it"), (7, "a b c price 5 another text"), (8, "w1 w2")]


def same(got, want):
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize(("shard", "block", "group", "every"), [(8 << 20, 1 << 24, 64, False), (2000, 1 << 24, 2, False), (1, 300, 64, False), (3000, 300, 3, True)])
def test_search_by_brute_force(spark, monkeypatch, shard, block, group, every):
    """One shard or many, items in one block or several, nodes opened alone or in groups, all terms of the index or the items'."""
    monkeypatch.setattr(lexical, "SHARD_BYTES", shard)
    monkeypatch.setattr(lexical, "BROADCAST_BYTES", block)
    monkeypatch.setattr(common, "BROADCAST_BYTES", block)
    monkeypatch.setattr(lexical, "GROUP", group)
    docs = made_docs()
    items = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id bigint, text string, score int")
    same(lexical.ranked(frame(spark, docs), items, 10, every).collect(), brute_search(docs, ITEMS, 10, every))


def test_search_edges(spark):
    docs, items = frame(spark, made_docs()), spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert lexical.ranked(docs.limit(0), items).count() == 0 and lexical.ranked(docs, items.limit(0)).count() == 0
    assert lexical.ranked(frame(spark, [(1, None, None, None), (2, "!", None, None)]), items).count() == 0
    long = [(i, "w1 " * (300_000 if i == 2 else 2) + f"w{i}", None, None) for i in range(5)]
    same(lexical.ranked(frame(spark, long), items.filter("item_id = 8")).collect(), brute_search(long, [(8, "w1 w2")]))


def test_tree_finds_the_top_of_each_range():
    """Random postings: bounds hold, ties go by id, the floor of earlier shards cuts, the stored form is read back."""
    rng = np.random.default_rng(9)
    for size, terms, k in ((1, 1, 1), (2, 3, 2), (37, 6, 5), (300, 12, 10)):
        held = [np.sort(rng.choice(size, rng.integers(1, size + 1), replace=False)) for _ in range(terms)]
        starts = np.concatenate([[0], np.cumsum([len(h) for h in held])])
        at, impact, term = np.concatenate(held), rng.integers(1, 9, starts[-1]), np.repeat(np.arange(terms), np.diff(starts))
        order = np.lexsort((at, -impact, term))
        at, impact = at[order], impact[order]
        bits = lexical.DualSorted.bits(at, size)
        tree = lexical.load(np.packbits(bits, axis=1).tobytes(), impact.astype("<i4").tobytes(), size)
        w, ids = rng.integers(0, 5, terms), np.arange(size) * 3
        score = np.zeros(size, np.int64)
        np.add.at(score, at, w[term] * impact)
        want = sorted((-int(s), int(i)) for s, i in zip(score, ids, strict=True) if s > 0)
        got = tree.top(starts[:-1], starts[1:], w, k, ids)
        assert got == [(-s, -i) for s, i in want[:k]]
        before = [(int(score.max()), -1)] * k
        assert tree.top(starts[:-1], starts[1:], w, k, ids, before) == sorted([*before, *got], reverse=True)[:k]


# ---- SQL ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_risk_rules", "op12_wavelet_search", "op13_filter_audit"])
def test_equal_to_sql(spark, tmp_path, name):
    docs = frame(spark, made_docs()).select("doc_id", "text", "lang", "source")
    tables = {"documents": docs, "labels": spark.createDataFrame(LABEL_ROWS, LABELS), "benchmark": spark.createDataFrame(ITEMS, "item_id bigint, text string")}
    con = duckdb.connect()
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        if folder != str(tmp_path):
            for t in tables:
                con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        got = queries.QUERIES[name](spark, folder)
        cur = con.execute(queries.ORACLE_SQL[name])
        assert [d[0] for d in cur.description] == got.columns
        assert Counter(map(str, map(tuple, got.collect()))) == Counter(map(str, cur.fetchall()))
