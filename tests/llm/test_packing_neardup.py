"""Packing with many sources and their targets; near-duplicates without ids."""

import numpy as np

from engram.llm import neardup, packing, queries


def test_packing_keeps_many_sources_and_their_targets(spark):
    names = [None, *(f"s{i:03d}" for i in range(1, 600))]
    rows = [(2 * i + j, "one plain sentence of some words that is said again " * 10, s) for i, s in enumerate(names) for j in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    targets = {s: 3.0 if i % 2 else 1.0 for i, s in enumerate(names) if s}
    got = packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"), targets).collect()
    own = {i: s for i, _, s in rows}
    assert all(r.source == own[r.doc_id] for r in got) and {r.source for r in got} == set(names)
    size = {r.doc_id: r.doc_tokens for r in got}
    assert sum(r.length for r in got) == sum(size.values())
    seqs = {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append(r)
    for w in range(8):
        assert sum(r.length for r in seqs[w]) == 4096
        heavy = sum(r.length for r in seqs[w] if targets.get(r.source) == 3.0)
        assert abs(heavy / 4096 - 0.75) < 0.05
        # from the first window to this one each source is off by its part of one round at most
        for s in names[1:]:
            share = 4096 * targets[s] / sum(targets.values())
            n = sum(r.length for v in range(w + 1) for r in seqs[v] if r.source == s)
            assert abs(n - share * (w + 1)) <= share + 2


def test_layout_of_many_queues_is_that_of_few():
    rng = np.random.default_rng(8)
    totals = [int(x) for x in rng.integers(0, 90, 700)]
    plan, order, left, spent = packing.Layout(totals, None, 64), [], list(totals), [0] * len(totals)
    for p in packing.phases(totals, None, 64):
        deficit = [0] * len(totals)
        for _ in range(p["rounds"]):
            for s, c in enumerate(p["credit"]):
                deficit[s] += c
                n = min(deficit[s] >> packing.POINT, left[s])
                deficit[s] -= n << packing.POINT
                order += [(s, spent[s] + j) for j in range(n)]
                left[s], spent[s] = left[s] - n, spent[s] + n
    queue = np.arange(len(totals))
    row, x, n, at = (c.tolist() for c in [*plan.stretches(queue, 0 * queue, np.array(totals))[:2], *plan.stretches(queue, 0 * queue, np.array(totals))[:1:-1]])
    place = [None] * len(order)
    for s, a, m, h in zip(row, x, n, at, strict=True):
        for j in range(m):
            place[h + j] = (s, a + j)
    assert place == order and len(order) == sum(totals)


def test_null_ids_among_copies(spark):
    base = [f"word{i}" for i in range(60)]
    near = " ".join([*base[:-1], "other"])
    copy, apart, lone = " ".join(base), " ".join(f"far{i}" for i in range(60)), " ".join(f"own{i}" for i in range(60))
    # copies, a near copy without an id, a near copy of a text that has no id at all, and rows of no component
    rows = [(None, copy), (5, copy), (7, copy), (None, near), (None, apart), (None, apart), (9, " ".join([*apart.split()[:-1], "x"])), (None, lone), (None, lone), (None, None), (3, None)]
    docs = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(rows)], "doc_id bigint, text string, n int")
    sets = [set(map(tuple, zip(*(t.split()[i:] for i in range(5)), strict=False))) if t else set() for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    expected = []
    for i, (own, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if group[j] == group[i]]
        least = min((x for x in ids if x is not None), default=None)
        expected.append((own, len(sets[i]), least, own == least if least is not None else group.index(group[i]) == i))
    order = lambda r: tuple((x is not None, x) for x in r)
    got = sorted((tuple(r) for r in neardup.near_duplicates(docs).collect()), key=order)
    assert [r[2] for r in expected] == [5, 5, 5, 5, 9, 9, 9, None, None, None, 3] and got == sorted(expected, key=order)
    kept = neardup.keep_one(docs)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(5, copy), (9, rows[6][1]), (0, lone), (0, ""), (3, "")])
