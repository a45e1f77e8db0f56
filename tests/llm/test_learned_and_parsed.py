"""The support vectors' ratios and optimum, and the parser's boundaries, against plain forms of their definitions; and
tables without rows or with odd ones through the pipeline."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from engram.llm import fingerprint, langid, quality


def primal(w, x, y, cost):
    return 0.5 * w @ w + (cost * np.maximum(0, 1 - y * (x @ w))).sum()


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_dual_descent_closes_the_gap(seed):
    """The primal value meets the dual one that projected gradient steps on the whole dual problem reach."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(60, 8))
    y = np.where(x @ rng.normal(size=8) + rng.normal(size=60) > 0, 1, -1)
    cost = np.where(y == 1, 0.7, 1.3)
    w = quality.dual_descent([(np.arange(8), v) for v in x], y, 8, cost, epochs=500)
    gram, alpha = (x @ x.T) * np.outer(y, y), np.zeros(60)
    for _ in range(60_000):
        alpha = np.clip(alpha + (1 - gram @ alpha) / np.linalg.norm(gram, 2), 0, cost)
    dual = alpha.sum() - 0.5 * alpha @ gram @ alpha
    assert dual <= primal(w, x, y, cost) <= dual * 1.005
    assert np.allclose(w, (alpha * y) @ x, atol=0.05)


def test_ratios_by_their_definition():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    texts = [" ".join(rng.choices(words[:20] if i % 3 else words[10:], k=12)) for i in range(60)]
    features = quality.Features()
    codes, owner = features(texts)
    sample = [(codes[owner == i], int(i % 3 > 0)) for i in range(60)]
    model = quality.fit(sample, 0.6)
    good, bad, df = Counter(), Counter(), Counter()
    for c, y in sample:
        (good if y else bad).update(c.tolist())
        df.update(c.tolist())
    every = sorted(df)
    p, q = ({c: side[c] + 1 for c in every} for side in (good, bad))
    want = {c: np.log(p[c] / sum(p.values())) - np.log(q[c] / sum(q.values())) for c in every if df[c] >= quality.MIN_DOCS or c == 0}
    assert sorted(want) == model["codes"].tolist()
    assert np.allclose(model["scale"], [want[c] ** 2 for c in model["codes"].tolist()])
    held = quality.score(model, *features(["w0 w1 w2 w3 w4 w5 w6 w7", "w22 w25 w27 w21 w29 w28"]), 2)
    assert held[0] > 0.6 > held[1]


def tossed(names):
    """Coin tosses of a row of names by single bits; the first one differs from what stands before it in bit 0."""
    labels = names
    for _ in range(fingerprint.TOSSES):
        new = []
        for i, own in enumerate(labels):
            left = labels[i - 1] if i else own ^ 1
            low = next(b for b in range(64) if (left ^ own) >> b & 1) if left != own else 0
            new.append(2 * low + (own >> low & 1) if left != own else 0)
        labels = new
    return labels


def boundaries(symbols):
    """Where phrases begin, as counts of symbols: runs are one, phrases begin at the first and at the peaks of tosses."""
    runs, i = [], 0
    while i < len(symbols):
        j = i
        while j < len(symbols) and symbols[j] == symbols[i]:
            j += 1
        name = symbols[i]
        if j - i > 1:
            name = int(fingerprint.mix(np.array([(name + (j - i) * int(fingerprint._WEIGHTS[7])) % (1 << 64)], np.uint64))[0])
        runs.append((i, name))
        i = j
    label = tossed([n for _, n in runs])
    last = len(label) - 1
    return [at for k, (at, _) in enumerate(runs) if k == 0 or (label[k] > label[k - 1] and (k == last or label[k] > label[k + 1]))]


@pytest.mark.parametrize("letters", ["ab", "abcdefgh ", "aé日😀 \n"])
def test_phrases_by_single_tosses(letters):
    rng = random.Random(len(letters))
    for n in (1, 2, 3, 17, 120, 500):
        text = "".join(rng.choice(letters) * rng.choice((1, 1, 1, 4)) for _ in range(n))
        levels = fingerprint.phrases(text)
        symbols, begin = [ord(c) for c in text], list(range(len(text)))
        for level in levels:
            begin = [begin[i] for i in boundaries(symbols)]
            assert [s for s, _, _ in level] == begin
            symbols = [name for _, _, name in level]
        # phrases of one name are one text, and the other way round where all that a phrase is made of lies within it
        named = {}
        for s, e, name in levels[0]:
            assert named.setdefault(name, text[s:e]) == text[s:e]


def test_pipeline_without_rows(spark, tmp_path, sf):
    import corpus_pipeline as cp

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    labels.limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_stages_with_odd_rows(spark, sf):
    """Null ids, texts and languages, repeated rows and clashing columns; what stays has the columns it came with."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = docs.limit(3).select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema.fields))
    rows = docs.unionByName(docs.limit(5)).unionByName(odd).withColumns({"score": F.lit("s"), "predicted": F.lit("p"), "y": F.lit("y"), "lang_pred": F.lit("l"), "held_out": F.lit("h")})
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = langid.keep_identified(rows)
    good = quality.keep_good(rows, labels)
    assert kept.columns == rows.columns == good.columns
    assert kept.filter("text is null").count() == 0 and 0 < kept.count() <= 65 and 0 < good.count() <= 68
    assert {r.score for r in good.collect()} == {"s"} and {r.lang_pred for r in kept.collect()} == {"l"}
