"""Language ID by a linear-chain conditional random field over the words of a text.

Each word gets scores for every language from hashed affixes, character n-grams and itself as a lexicon entry; learned
transitions tie neighbours, so that labels switch where the text does. Forward-backward gives each word its posterior;
a document's language is the one with the largest share of posterior mass, and that share is its score.

Words carry no labels of their own in the corpus, only documents do. A fit splices runs of words from documents of
different languages into code-switched sequences, each word labelled by the document that it is from; so the transitions
learn how long languages last, and a document's language is learned from its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import arrow_map, crc_mod, slices

#: Documents a language that a fit takes at most, documents of all languages together (each has one at least),
#: hashed features.
SAMPLE, TOTAL, SIZE = 200, 12_800, 1 << 17
SEQUENCES, LENGTH, RUN, BATCH, EPOCHS, RATE, RIDGE = 3000, 48, 12, 250, 6, 0.15, 1e-6
SLICE = 5 << 20
WORD = regex.compile(r"\p{L}+")
KINDS = 9


def _fold(codes: np.ndarray, kind: int) -> np.ndarray:
    x = (codes.astype(np.uint64) + np.uint64(kind * 0x51ED27)) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - 17)).astype(np.int32)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word) of every affix of 1 to 3 letters, every n-gram of 2 and 3 letters with margins, and the word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = np.frombuffer(("<" + "><".join(words) + ">").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) if words else np.zeros(0, np.uint64)
    first = np.cumsum(lengths) - lengths
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    end = first + lengths
    m = np.uint64(0x100000001B3)
    two = text[:-1] * m + text[1:] if text.size else text
    three = two[:-1] * m + text[2:] if text.size else text
    same2, same3 = owner[1:] == owner[:-1], owner[2:] == owner[:-2]
    grams = [(_fold(two[same2], 1), owner[1:][same2]), (_fold(three[same3], 2), owner[2:][same3])]
    ids = np.arange(len(words), dtype=np.int32)
    for kind, n in ((3, 2), (4, 3)):  # with the margin, prefixes and suffixes of 1 and 2 letters are n-grams of other kinds
        ok = lengths >= n
        for at, k in ((first[ok], kind), (end[ok] - n, kind + 2)):
            grams.append((_fold(two[at] if n == 2 else three[at], k), ids[ok]))
    ok = lengths >= 5
    for at, k in ((first[ok] + 1, 7), (end[ok] - 4, 8)):
        grams.append((_fold(three[at], k), ids[ok]))
    if len(words):
        rank = np.arange(text.size, dtype=np.uint64) - np.repeat(first, lengths).astype(np.uint64)
        whole = np.add.reduceat((text + np.uint64(1)) * ((rank * np.uint64(2) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9) ^ rank), first)
        grams.append((_fold(whole ^ (whole >> np.uint64(29)), KINDS), ids))
    return np.concatenate([g for g, _ in grams]), np.concatenate([o for _, o in grams])


def emissions(weights: np.ndarray, words: list[str]) -> np.ndarray:
    """(words, languages) scores: the mean weight of a word's features, times the square root of their number."""
    code, owner = features(words)
    n = np.bincount(owner, minlength=len(words))
    sums = np.stack([np.bincount(owner, weights[code, k], len(words)) for k in range(weights.shape[1])], axis=1)
    return sums / np.sqrt(np.maximum(n, 1))[:, None]


def forward_backward(emit: np.ndarray, index: np.ndarray, start: np.ndarray, length: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Posteriors (all positions, labels) of sequences laid end to end; emit[index] are their exponentiated scores.

    All sequences advance together, longest first, so a step is one operation over those that last so long.
    """
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    most = int(length[0]) if length.size else 0
    alive = np.searchsorted(-length, -np.arange(1, most + 1), side="right")
    alpha = np.empty((index.size, emit.shape[1]))
    a = None
    for t in range(most):
        k = alive[t]
        at = start[:k] + t
        a = (a[:k] @ trans if t else first) * emit[index[at]]
        a /= a.sum(axis=1, keepdims=True)
        alpha[at] = a
    beta = np.ones((0, emit.shape[1]))
    for t in range(most - 1, -1, -1):
        k = alive[t]
        at = start[:k] + t
        if t + 1 < most:
            later = alive[t + 1]
            b = np.ones((k, emit.shape[1]))
            b[:later] = (emit[index[at[:later] + 1]] * beta) @ trans.T
            b /= b.sum(axis=1, keepdims=True)
        else:
            b = np.ones((k, emit.shape[1]))
        beta = b
        p = alpha[at] * b
        alpha[at] = p / p.sum(axis=1, keepdims=True)
    return alpha


def fit(docs: list[tuple[str, str]], seed: int = 11) -> dict:
    """{languages, weights, trans, first} from (language, text) rows."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in docs})
    k = len(languages)
    model = {"languages": languages, "weights": np.zeros((SIZE, max(k, 1))), "trans": np.full((max(k, 1),) * 2, 1 / max(k, 1)), "first": np.full(max(k, 1), 1 / max(k, 1))}
    by: list[list[list[str]]] = [[w for lang, t in docs if lang == x and (w := WORD.findall(t.lower()))] for x in languages]
    languages_used = [i for i in range(k) if by[i]]
    if len(languages_used) < 2:
        return model
    number: dict[str, int] = {}
    seqs, labels = np.empty((SEQUENCES, LENGTH), np.int64), np.empty((SEQUENCES, LENGTH), np.int64)
    for s in range(SEQUENCES):
        row, lab = [], []
        while len(row) < LENGTH:
            y = languages_used[rng.integers(len(languages_used))]
            words = by[y][rng.integers(len(by[y]))]
            n = 1 + int(rng.geometric(1 / RUN))
            at = int(rng.integers(max(1, len(words) - n + 1)))
            got = words[at : at + n]
            row += [number.setdefault(w, len(number)) for w in got]
            lab += [y] * len(got)
        seqs[s], labels[s] = row[:LENGTH], lab[:LENGTH]
    words = list(number)
    code, owner = features(words)
    order = np.argsort(owner, kind="stable")
    code, owner = code[order], owner[order]
    cuts = np.searchsorted(owner, np.arange(len(words) + 1))
    count = np.diff(cuts)
    w, logt = np.zeros((SIZE, k)), np.zeros((k, k))
    g2w, g2t = np.full((SIZE, k), 1e-8), np.full((k, k), 1e-8)
    for _ in range(EPOCHS):
        for part in np.array_split(rng.permutation(SEQUENCES), SEQUENCES // BATCH):
            x, y = seqs[part], labels[part]
            uniq, index = np.unique(x.ravel(), return_inverse=True)
            size = count[uniq]
            rows = np.repeat(cuts[uniq] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            c, o = code[rows], np.repeat(np.arange(uniq.size), size)
            scale = 1 / np.sqrt(size)
            sums = np.stack([np.bincount(o, w[c, j], uniq.size) for j in range(k)], axis=1) * scale[:, None]
            e = np.exp(sums - sums.max(axis=1, keepdims=True))
            t = np.exp(logt - logt.max())
            post, pairs = _train_posteriors(e[index].reshape(*x.shape, k), t)
            d = post.copy()
            np.put_along_axis(d, y[..., None], np.take_along_axis(d, y[..., None], 2) - 1, 2)
            d = d.reshape(-1, k) / x.shape[0]
            dw = np.stack([np.bincount(index, d[:, j], uniq.size) for j in range(k)], axis=1) * scale[:, None]
            used, inv = np.unique(c, return_inverse=True)
            grad = np.stack([np.bincount(inv, dw[o, j], used.size) for j in range(k)], axis=1) + RIDGE * w[used]
            g2w[used] += grad * grad
            w[used] -= RATE * grad / np.sqrt(g2w[used])
            seen = np.zeros((k, k))
            np.add.at(seen, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1.0)
            gt = (pairs - seen) / x.shape[0]
            g2t += gt * gt
            logt -= RATE * gt / np.sqrt(g2t)
    model["weights"] = w.astype(np.float32)
    model["trans"] = np.exp(logt - logt.max())
    return model


def _train_posteriors(e: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(posteriors, expected transitions) of sequences of one length."""
    n, length, k = e.shape
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for i in range(1, length):
        a = (alpha[:, i - 1] @ t) * e[:, i]
        alpha[:, i] = a / a.sum(axis=1, keepdims=True)
    pairs = np.zeros((k, k))
    for i in range(length - 2, -1, -1):
        right = e[:, i + 1] * beta[:, i + 1]
        joint = alpha[:, i, :, None] * t * right[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = right @ t.T
        beta[:, i] = b / b.sum(axis=1, keepdims=True)
    p = alpha * beta
    return p / p.sum(axis=2, keepdims=True), pairs


class Tagger:
    def __init__(self, model: dict):
        self.model = model
        self.languages = model["languages"]

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(posteriors of all words, where each text's words start, how many it has)."""
        number: dict[str, int] = {}
        counts, index = [], []
        for t in texts:
            words = WORD.findall(t.lower())
            counts.append(len(words))
            index += [number.setdefault(w, len(number)) for w in words]
        length = np.array(counts, np.int64)
        start = np.cumsum(length) - length
        score = emissions(self.model["weights"], list(number))
        emit = np.exp(score - score.max(axis=1, keepdims=True)) if len(number) else score
        return forward_backward(emit, np.array(index, np.int64), start, length, self.model["trans"], self.model["first"]), start, length

    def label(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """(language or und, score) of each text: the language of most posterior mass and its share."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        post, start, length = self.posteriors(texts)
        owner = np.repeat(np.arange(len(texts)), length)
        mass = np.stack([np.bincount(owner, post[:, k], len(texts)) for k in range(len(self.languages))], axis=1)
        best = mass.argmax(axis=1)
        score = np.where(length > 0, mass.max(axis=1) / np.maximum(length, 1), 0.0)
        return [self.languages[b] if n else "und" for b, n in zip(best.tolist(), length.tolist(), strict=True)], np.clip(score, 0.0, 1.0)

    def words(self, text: str) -> list[tuple[int, int, str, float]]:
        """(start, end, language, posterior) of the words of the lower-case text."""
        low = text.lower()
        post, _, _ = self.posteriors([text])
        return [(m.start(), m.end(), self.languages[int(p.argmax())], float(p.max())) for m, p in zip(WORD.finditer(low), post, strict=True)]


def train(docs: DataFrame, folds: int = 5, held: int = 0, per_language: int = SAMPLE) -> dict:
    """The model from rows with a language and a text outside the held-out fold: all languages, ``per_language`` rows of each
    at most, fewer where these would be more than TOTAL.

    The ids of a language are dealt into as many buckets by hash, and each bucket gives its smallest hash; so the rows
    are aggregated before any shuffle, however many rows a language has. Of an id's rows of a language one counts, that of
    the least text; rows without an id are left out. An empty table gives a model without languages.
    """
    rows = docs.filter("lang is not null and text is not null and doc_id is not null").filter(crc_mod("doc_id", folds) != held)
    languages = rows.select("lang").distinct().count()
    each = max(1, min(per_language, TOTAL // max(1, languages)))
    h = F.xxhash64("doc_id")
    ids = rows.groupBy("lang", F.pmod(h, F.lit(each)).alias("b")).agg(F.min(F.struct(h.alias("h"), "doc_id")).alias("x"))
    picked = ids.select("lang", "x.doc_id")  # as many rows as languages times ``each``
    texts = rows.select("doc_id", "lang", "text").join(F.broadcast(picked), ["lang", "doc_id"], "left_semi")
    texts = texts.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    return fit([(r.lang, r.text) for r in sorted(texts.collect(), key=lambda r: (r.doc_id, r.lang))])


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """``docs`` with lang_pred and score (0 to 1).

    A text that is null or has no letter is ``und`` with score 0, as is every text without learned languages. Rows are
    independent; repeated rows keep their count; an empty table gives an empty one. Columns named lang_pred or score
    are replaced; others stay. The model (SIZE features times the languages) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        for b in slices(batches, limit=SLICE):
            lang, score = tagger.label([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(f) for f in b.schema.names), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, "lang_pred", "score"])

    rows = docs.drop("lang_pred", "score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return arrow_map(rows, run, f"{kinds}, lang_pred string, score double")


def word_labels(docs: DataFrame, model: dict, id_col: str = "doc_id") -> DataFrame:
    """(id, words array of (start, end, lang, posterior)): the labels of a text's words, in its lower-case form.

    A null text, one without letters, and any text without learned languages have no words. Rows are independent; repeated
    rows keep their count; an empty table gives an empty one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("posterior", pa.float64())]))
        for b in slices(batches):
            found = [[dict(zip(("start", "end", "lang", "posterior"), w, strict=True)) for w in (tagger.words(t) if t and tagger.languages else [])] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(found, kind)], names=["id", "words"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), "text")
    return arrow_map(rows, run, f"id {kind}, words array<struct<start: int, end: int, lang: string, posterior: double>>").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, least: float = 0.34) -> DataFrame:
    """The documents whose language is found with a score of ``least`` or more, with their own columns.

    Null texts and those without letters go, as they have no language; if no document has a known language to learn from,
    all go. Repeated rows stay or go together; an empty table gives an empty one; columns named lang_pred or score, which
    the tagger replaces, come back as they were.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return identify(rows, train(docs)).filter((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
