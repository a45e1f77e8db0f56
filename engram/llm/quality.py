"""Naive Bayes support vectors: n-gram indicators scaled by class log-count ratios, a linear hinge-loss model on top.

N-grams are of two streams of the same tokens: the words themselves (unigrams) and their forms (unigrams and bigrams).
A form tells a token's case, digits, length and marks on either side, and whether it repeats its left neighbour, so that
text of invented words still has telling n-grams. Each indicator is scaled by r = log((p / |p|) / (q / |q|)), p and q
being the smoothed counts of the documents of either class that have it; the model is fitted by dual coordinate descent
on the unit-length rows, then a logistic curve maps margins to the probability of class 1 at its true share.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import arrow_map, bounded_sample, crc_mod, kept, slices

#: Documents of each class that a fit takes at most; those of the smallest hash of their id.
SAMPLE = 4000
FORM_BITS, WORD_BITS = 13, 18
MIN_DOCS = 3
WORD_ENTRIES = 300_000
_CASES = {(True, False): 1, (False, True): 2, (True, True): 3, (False, False): 0}


def form(token: str) -> int:
    """A hash (FORM_BITS - 1 bits) of case, digits, length and outer marks."""
    core = token.strip("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»")
    at = token.find(core) if core else 0
    before, after = (token[:at], token[at + len(core) :]) if core else (token, "")
    case = "U" if core.isupper() and len(core) > 1 else "T" if core[:1].isupper() else "l" if core.islower() else "m"
    digits = "d" if any(c.isdigit() for c in core) else ""
    inner = "p" if core and not core.isalnum() else ""
    key = f"{case}{digits}{inner}{min(len(core), 40).bit_length()}|{before[:3]}|{after[:3]}"
    return zlib.crc32(key.encode("utf-8", "surrogatepass")) >> (33 - FORM_BITS)


class Features:
    """Distinct n-gram codes of texts; a worker keeps the codes of the tokens that it has met."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def _code(self, token: str) -> int:
        word = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) >> (32 - WORD_BITS)
        code = word << (FORM_BITS - 1) | form(token)
        if len(self.known) >= WORD_ENTRIES:
            self.known.clear()
        if len(token) <= 40:
            self.known[token] = code
        return code

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(code, text) pairs, distinct, ordered by text. A text always has the code 0, so no row is empty."""
        known, code = self.known, self._code
        parts, counts = [], []
        for t in texts:
            tokens = t.split()
            counts.append(len(tokens))
            parts += [known[w] if w in known else code(w) for w in tokens]
        both = np.array(parts, np.int64)
        owner = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
        words, forms = both >> (FORM_BITS - 1), both & ((1 << (FORM_BITS - 1)) - 1)
        same_text = owner[1:] == owner[:-1]
        repeats = np.zeros(both.size, np.int64)
        repeats[1:] = (both[1:] == both[:-1]) & same_text
        forms = forms << 1 | repeats
        pairs = (forms[:-1] << FORM_BITS | forms[1:])[same_text]
        # the three kinds of n-grams have ranges of their own; a text's number stands above them
        shift = np.int64(2 * FORM_BITS + 2)
        kinds = ((words, owner, 1), (forms, owner, 2), (pairs, owner[1:][same_text], 3))
        keys = [np.arange(len(texts), dtype=np.int64) << shift]
        keys += [np.unique(o << shift | np.int64(k) << np.int64(2 * FORM_BITS) | c) for c, o, k in kinds]
        key = np.concatenate(keys)
        key.sort()
        return key & ((np.int64(1) << shift) - 1), key >> shift


def dual_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 30, seed: int = 7) -> np.ndarray:
    """Weights of the L2-regularised hinge-loss machine: each step solves the dual problem in one coordinate exactly."""
    rng = np.random.default_rng(seed)
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norm = np.array([v @ v for _, v in rows])
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(rows)):
            idx, v = rows[i]
            slope = y[i] * (w[idx] @ v) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[idx] += step * y[i] * v
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-3:
            break
    return w


def platt(margin: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """(a, b) with p = 1 / (1 + exp(-(a * margin + b))), fitted with the classes weighted to ``share`` of class 1."""
    weight = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
    goal = np.where(y == 1, 1 - 1 / ((y == 1).sum() + 2), 1 / ((y == 0).sum() + 2))
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        gradient = x @ (weight * (p - goal)) + np.array([1e-4 * a, 0])
        curve = (x * (weight * p * (1 - p))) @ x.T + np.diag([1e-4, 1e-9])
        step = np.linalg.solve(curve, gradient)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    return float(max(a, 1e-3)), float(b)


def fit(sample: list[tuple[np.ndarray, int]], share: float) -> dict:
    """{codes, weights, scale, a, b} from (codes, label) rows; without rows of both classes, the constant ``share``."""
    labels = np.array([y for _, y in sample], np.int64)
    flat = {"codes": np.zeros(0, np.int64), "weights": np.zeros(0), "scale": np.zeros(0), "a": 1.0, "b": float(np.log(share / (1 - share)))}
    if len(set(labels.tolist())) < 2:
        return flat
    every = np.concatenate([c for c, _ in sample])
    owner = np.repeat(labels, [c.size for c, _ in sample])
    codes, inverse, df = np.unique(every, return_inverse=True, return_counts=True)
    p = np.bincount(inverse, owner, codes.size) + 1
    q = df + 2 - p
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    used = (df >= MIN_DOCS) | (codes == 0)
    codes, ratio = codes[used], ratio[used]
    rows = []
    for c, _ in sample:
        at = np.searchsorted(codes, c)
        at = at[(at < codes.size) & (codes[np.minimum(at, codes.size - 1)] == c)]
        v = ratio[at]
        rows.append((at, v / max(np.sqrt(v @ v), 1e-9)))
    cost = np.where(labels == 1, len(labels) / (2 * labels.sum()), len(labels) / (2 * (1 - labels).sum()))
    # margins for the curve come from the halves that a machine hasn't seen
    half = np.arange(len(rows)) % 2
    margin = np.zeros(len(rows))
    for part in (0, 1):
        seen, rest = np.flatnonzero(half != part), np.flatnonzero(half == part)
        w = dual_descent([rows[i] for i in seen], 2 * labels[seen] - 1, codes.size, cost[seen])
        margin[rest] = [w[rows[i][0]] @ rows[i][1] for i in rest]
    a, b = platt(margin, labels, share)
    w = dual_descent(rows, 2 * labels - 1, codes.size, cost)
    return {"codes": codes, "weights": w * ratio, "scale": ratio * ratio, "a": a, "b": b}


def score(model: dict, codes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    known = model["codes"]
    if known.size:
        at = np.minimum(np.searchsorted(known, codes), known.size - 1)
        hit = known[at] == codes
        at, owner = at[hit], owner[hit]
        total, norm = np.bincount(owner, model["weights"][at], n), np.bincount(owner, model["scale"][at], n)
        margin = total / np.maximum(np.sqrt(norm), 1e-9)
    else:
        margin = np.zeros(n)
    return 1 / (1 + np.exp(-np.clip(model["a"] * margin + model["b"], -30, 30)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int) -> DataFrame:
    """(doc_id, text, y) of the rows that may be learned from; an id's labels count once, the largest."""
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(label).cast("int").alias("y"))
    marks = marks.filter("doc_id is not null and y in (0, 1)").filter(crc_mod("doc_id", folds) != held).groupBy("doc_id").agg(F.max("y").alias("y"))
    return marks


def sample_of(docs: DataFrame, marks: DataFrame, rows: int) -> tuple[DataFrame, float]:
    """(doc_id, text, y): at most ``rows`` labelled documents of each class, and the share of class 1 among all.

    Of an id's rows one counts, that of the least text, so as many rows as ids may reach the driver; null texts are empty.
    """
    n, ones = marks.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = (ones + 1) / (n + 2)
    picked = bounded_sample(marks.filter("y = 1"), rows, "doc_id").unionByName(bounded_sample(marks.filter("y = 0"), rows, "doc_id"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(F.broadcast(picked), "doc_id")  # picked: 2 * rows ids at most
    return texts.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y"), share


def _features() -> Features:
    return kept(f"{__name__}:features", Features)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, held: int = 0, rows: int = SAMPLE) -> dict:
    """The model of ``label`` from the labelled rows outside the held-out fold, ``rows`` of each class at most.

    Null ids and labels are left out; an id's labels count once, the largest; an empty table gives a model of the prior.
    """
    sample, share = sample_of(docs, labelled(docs, labels, label, folds, held), rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            codes, owner = _features()(b.column("text").to_pylist())
            cuts = np.searchsorted(owner, np.arange(b.num_rows + 1))
            out = [codes[cuts[i] : cuts[i + 1]].astype("<i8").tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(out, pa.binary())], names=["doc_id", "y", "codes"])

    got = arrow_map(sample, run, "doc_id bigint, y int, codes binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.codes)))
    return fit([(np.frombuffer(bytes(r.codes), "<i8"), r.y) for r in got], share)


def classify(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score and predicted (1 from ``threshold`` on).

    A null or empty text has the code 0 alone and takes the score that this gives. Rows are independent; repeated rows
    keep their count; an empty table gives an empty one. Columns named score or predicted are replaced; others stay.
    The model (a bounded number of n-grams, set by ``rows``) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            codes, owner = _features()([t or "" for t in b.column("text").to_pylist()])
            p = score(shared.value, codes, owner, b.num_rows)
            kept = [(f, b.column(f)) for f in b.schema.names]
            yield pa.RecordBatch.from_arrays([*(c for _, c in kept), pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())], names=[*(f for f, _ in kept), "score", "predicted"])

    rows = docs.drop("score", "predicted")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return arrow_map(rows, run, f"{kinds}, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier predicts to be good, with their own columns.

    A null or empty text is judged by the score of an empty one. Repeated rows stay or go together; an empty table gives an
    empty one; columns named score or predicted come back as they were.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), "text")
    return classify(rows, train(docs, labels), threshold).filter("predicted = 1").select("row.*")
