"""Weighted finite-state pattern grammar for toxic clauses.

Five lexical machines read a word letter by letter and write its class, with a weight on the last arc: I insult (exact
words and stems, learned), T threat, G target, N negation, R reported speech, or _ for the rest. Their union, one trie, is
deterministic. Grammar transducers read classes and mark insults and threats: negation holds for some words, target and
reported speech mark what stands before and behind them in the clause. What depends on both sides of a word is no matter
for one machine that reads left to right, so the grammar is a bimachine: negation, report and target composed reading the
clause forwards, then report, target and verdict composed reading its output backwards.

Weights are logarithms: composition adds them, and a document sums its matches of a kind in the log semiring. Its score is a
logistic function of these sums. Words and stems of insults, with their weights, and the weights of the match kinds are
learned from labelled rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import arrow_map, slices
from engram.llm.quality import labelled, sample_of
from engram.session import materialize

#: Labelled documents of each class that a fit takes at most.
SAMPLE = 3000
#: A term must be this much (a logarithm) more frequent among toxic documents, and explain one in MIN_PART of them, from
#: MIN_DOCS[0] to MIN_DOCS[1] documents; a stem has 4 to 7 letters; candidates that reach the driver.
ODDS, MIN_PART, MIN_DOCS, STEMS, CANDIDATES = 3.0, 40, (3, 8), (4, 8), 4000
#: Evidence, in nats against chance, from which a term counts although other terms explain its documents.
EVIDENCE = 18.0
#: A stem may be telling only from its second or third word in a document on.
REPEATS = 3
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
CLAUSE_END = re.compile(r"[.!?;:\n]")

#: General words of the grammar in four languages.
THREATS = "kill murder hurt destroy strangle shoot stab tuer frapper détruire töten schlagen vernichten matar golpear destruir".split()
TARGETS = "you your they them he she him her tu toi vous ils elle du dich ihr euch sie ella ellos usted ustedes vosotros".split()
NEGATIONS = "not never no don't isn't aren't ne pas jamais nicht kein keine nie nunca jamás tampoco".split()
REPORTS = "said says told wrote quoted claimed reported dit déclaré écrit sagte sagt schrieb dijo dice escribió".split()

KINDS = ("plain", "targeted", "negated", "reported")
#: Weights of a match by its kind before any are learned.
FACTORS = {"plain": 1.0, "targeted": 1.3, "negated": 0.5, "reported": 0.6}


class Transducer:
    """States 0..n-1 with arcs (state, symbol) -> (state, output, weight); deterministic, start 0."""

    def __init__(self, states: int, step: Callable[[int, str], tuple[int, str, float]], symbols: Iterable[str]):
        self.symbols = tuple(symbols)
        self.arcs = {(s, a): step(s, a) for s in range(states) for a in self.symbols}

    def compose(self, after: Transducer) -> Transducer:
        """The machine that feeds this one's outputs to ``after``; only pairs that can be reached become states."""
        number, todo, arcs = {(0, 0): 0}, [(0, 0)], {}
        for s, t in todo:
            for a in self.symbols:
                s2, mid, w = self.arcs[s, a]
                t2, out, w2 = after.arcs[t, mid]
                if (s2, t2) not in number:
                    number[s2, t2] = len(number)
                    todo.append((s2, t2))
                arcs[number[s, t], a] = (number[s2, t2], out, w + w2)
        made = object.__new__(Transducer)
        made.symbols, made.arcs = self.symbols, arcs
        return made

    def run(self, symbols: Iterable[str]) -> list[tuple[str, float]]:
        """(output, weight) of each symbol."""
        state, out = 0, []
        for a in symbols:
            state, o, w = self.arcs[state, a]
            out.append((o, w))
        return out


#: Classes of words, and those with marks: n negated, r reported, t targeted.
CLASSES = ("I", "T", "G", "N", "R", "_")
MARKED = (*CLASSES, *(c + m for c in "IT" for m in ("n", "r", "t", "nr", "nt", "rt", "nrt")))


def negation(reach: int = 6) -> Transducer:
    """Marks insults and threats among the ``reach`` words behind a negation."""

    def step(s: int, a: str) -> tuple[int, str, float]:
        if a == "N":
            return reach, a, 0.0
        return max(0, s - 1), _mark(a, "n") if s else a, 0.0

    return Transducer(reach + 1, step, MARKED)


def _mark(symbol: str, mark: str) -> str:
    return symbol[0] + "".join(sorted({*symbol[1:], mark})) if symbol[0] in "IT" else symbol


def after(word: str, mark: str) -> Transducer:
    """Marks the insults and threats that the machine reads once it has read a word of a class."""
    return Transducer(2, lambda s, a: (1, a, 0.0) if a == word else (s, _mark(a, mark) if s else a, 0.0), MARKED)


def verdict() -> Transducer:
    """Reads marked classes, writes matches with the weight of their kind: negated, else reported, else targeted, else plain."""

    def step(s: int, a: str) -> tuple[int, str, float]:
        if a[0] not in "IT":
            return s, "", 0.0
        kind = next((k for m, k in (("n", "negated"), ("r", "reported"), ("t", "targeted")) if m in a), "plain")
        return s, ("insult " if a[0] == "I" else "threat ") + kind, math.log(FACTORS[kind])

    return Transducer(1, step, MARKED)


class Grammar:
    """The bimachine: ``forwards`` reads a clause's classes, ``backwards`` what that wrote, from the clause's end on."""

    def __init__(self):
        self.forwards = negation().compose(after("R", "r")).compose(after("G", "t"))
        self.backwards = after("R", "r").compose(after("G", "t")).compose(verdict())

    def run(self, classes: list[str]) -> list[tuple[str, float]]:
        """(match or nothing, weight) of each word."""
        there = self.forwards.run(classes)
        back = self.backwards.run([a for a, _ in reversed(there)])
        return [(o, w + v) for (o, w), (_, v) in zip(reversed(back), there, strict=True)]


def grammar() -> Grammar:
    return Grammar()


class Lexicon:
    """The five lexical machines as one trie of letters; where a word ends the arc writes its class and its weight.

    A stem accepts whatever letters follow, and a longer entry goes first. What a stem weighs goes by how many of the
    document's matched words have it, so its arc carries a weight for each such number up to REPEATS. The scan for the
    clauses to read is one pattern of all insults and threats.
    """

    def __init__(self, insults: dict[str, float], stems: dict[str, list[float]]):
        log = lambda w: math.log(w) if w > 0 else -math.inf
        self.next: list[dict[str, int]] = [{}]
        #: state -> (class, stem or nothing, weights), for words that end there and for those that go on from there
        self.whole: dict[int, tuple[str, str, list[float]]] = {}
        self.onward: dict[int, tuple[str, str, list[float]]] = {}
        for words, what in ((REPORTS, "R"), (NEGATIONS, "N"), (TARGETS, "G"), (THREATS, "T")):
            for w in words:
                self.whole[self._state(w)] = (what, "", [0.0])
        for stem, ladder in stems.items():
            self.onward[self._state(stem)] = ("I", stem, [log(w) for w in ladder])
        for w, weight in insults.items():
            self.whole[self._state(w)] = ("I", "", [log(weight)])
        words = sorted({*insults, *stems, *THREATS}, key=len, reverse=True)
        self.scan = re.compile("|".join(map(re.escape, words)))

    def _state(self, word: str) -> int:
        state = 0
        for c in word:
            if c not in self.next[state]:
                self.next[state][c] = len(self.next)
                self.next.append({})
            state = self.next[state][c]
        return state

    def read(self, word: str) -> tuple[str, str, list[float]]:
        """(class, stem, weights) that a lower-case word's path writes."""
        state, found = 0, None
        for c in word:
            state = self.next[state].get(c, -1)
            if state < 0:
                break
            found = self.onward.get(state, found)
        whole = self.whole.get(state)
        if whole and (whole[0] == "I" or found is None):
            return whole
        return found or ("_", "", [0.0])


def clauses(text: str, lexicon: Lexicon) -> Iterator[tuple[int, int]]:
    """Spans of the clauses of a lower-case text in which an insult or a threat may stand."""
    end = 0
    for m in lexicon.scan.finditer(text):
        at = m.start()
        if at < end or (at and text[at - 1].isalpha()):
            continue
        begin = end
        for stop in (".", "!", "?", ";", ":", "\n"):
            begin = max(begin, text.rfind(stop, begin, at) + 1)
        close = CLAUSE_END.search(text, at)
        end = close.end() if close else len(text)
        yield begin, end


def matches(text: str, lexicon: Lexicon, machine: Grammar) -> list[tuple[int, int, str, str, float]]:
    """(start, end, match, word, log weight) of a text's matches, in its lower-case form."""
    low, out = text.lower(), []
    stems: Counter = Counter()
    for begin, end in clauses(low, lexicon):
        words = list(WORD.finditer(low, begin, end))
        read = [lexicon.read(m.group()) for m in words]
        for m, (_, stem, weights), (what, weight) in zip(words, read, machine.run([c for c, _, _ in read]), strict=True):
            if what:
                stems[stem] += 1
                out.append((m.start(), m.end(), what, m.group(), weight, stem, weights))
    found = [(*m, w + weights[min(stems[stem], len(weights)) - 1 if stem else 0]) for *m, w, stem, weights in out]
    return [m for m in found if m[-1] > -math.inf]


def vector(found: list[tuple[int, int, str, str, float]]) -> list[float]:
    """A document's features: the weights of each kind of match summed in the log semiring, on top of one."""
    sums = Counter()
    for _, _, what, _, weight in found:
        sums[what] += math.exp(weight)
    return [math.log1p(sums[f"{what} {kind}"]) for what in ("insult", "threat") for kind in KINDS]


PRIOR = np.array([8.0] * len(KINDS) + [2.0] * len(KINDS))


def fit_weights(x: np.ndarray, y: np.ndarray, share: float, pull: float = 0.02) -> tuple[np.ndarray, float]:
    """Logistic weights, drawn to PRIOR and kept from going negative; classes weighted to their true shares."""
    w, b = PRIOR.copy(), math.log(share / (1 - share))
    weight = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum()))
    for _ in range(400):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        g = weight * (p - y)
        w = np.maximum(w - 2.0 * (x.T @ g + pull * (w - PRIOR) / 100), 0.0)
        b -= 2.0 * g.sum()
    return w, float(b)


def _terms(text: str) -> set[str]:
    """Words, and "stem*k" for stems of at least k of the text's words."""
    words = Counter(WORD.findall(text.lower()))
    stems: Counter = Counter()
    for w, k in words.items():
        for n in range(STEMS[0], min(STEMS[1], len(w) + 1)):
            stems[w[:n]] += k
    return {*words, *(f"{s}*{k}" for s, n in stems.items() for k in range(1, min(n, REPEATS) + 1))}


def learn_lexicon(counts: dict[str, tuple[int, int]], docs: list[set[str]], n1: int, n0: int) -> tuple[dict[str, float], dict[str, list[float]]]:
    """Words and stems of insults, from {term: (toxic, other documents)} and the terms of the toxic documents.

    First a greedy cover: each term must explain a number of documents that none before explains. Then the terms whose
    evidence alone is far beyond chance.
    """

    def odds(a: float, b: float) -> float:
        return math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))

    def evidence(a: int, b: int) -> float:
        p, share = a / (a + b), n1 / (n1 + n0)
        return a * math.log(p / share) + (b * math.log((1 - p) / (1 - share)) if b else 0.0)

    telling = {t: odds(*c) for t, c in counts.items() if odds(*c) >= ODDS}
    left, chosen = list(docs), []
    least = min(max(len(docs) // MIN_PART, MIN_DOCS[0]), MIN_DOCS[1])
    while True:
        seen = Counter(t for d in left for t in d if t in telling)
        # of terms that tell as much the whole word goes first, then the longest stem
        best = max((t for t in seen if seen[t] >= least), key=lambda t: (seen[t] * telling[t], "*" not in t, len(t), t), default=None)
        if best is None:
            break
        chosen.append(best)
        left = [d for d in left if best not in d]
    chosen += [t for t in telling if evidence(*counts[t]) >= EVIDENCE]
    # a stem goes if a longer one, or a word, has nearly all its documents: "wort" after "worthless"
    reach: dict[str, int] = {}
    for term in chosen:
        name = term.partition("*")[0]
        docs_of = max(counts.get(name, (0, 0))[0] if "*" not in term else 0, counts.get(f"{name}*1", (0, 0))[0] if "*" in term else 0, counts[term][0])
        for n in range(STEMS[0], len(name) + ("*" not in term)):
            reach[name[:n]] = max(reach.get(name[:n], 0), docs_of)
    words: dict[str, float] = {}
    stems: dict[str, list[float]] = {}
    for term in chosen:
        stem, star, k = term.partition("*")
        if not star:
            words[term] = min(telling[term], 6.0) / 6
            continue
        if reach.get(stem, 0) >= 0.9 * max(counts.get(f"{stem}*1", (0, 0))[0], counts[term][0]):
            continue
        ladder = stems.setdefault(stem, [0.0] * REPEATS)
        for i in range(int(k), REPEATS + 1):
            # documents with just i words of the stem, or at least REPEATS
            (a, b), (a2, b2) = (counts.get(f"{stem}*{j}", (0, 0)) if j <= REPEATS else (0, 0) for j in (i, i + 1))
            if a > a2:
                ladder[i - 1] = max(0.0, min(odds(a - a2, b - b2), 6.0) / 6)
            elif i > 1:
                ladder[i - 1] = max(ladder[i - 1], ladder[i - 2])
    return words, stems


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds four min-hashes of a text's runs of three words."""
    for b in slices(batches):
        hashes: list[list[int]] = [[], [], [], []]
        for t in b.column("text").to_pylist():
            w = t.split()
            runs = {zlib.crc32(" ".join(w[i : i + 3]).encode("utf-8", "surrogatepass")) for i in range(max(1, len(w) - 2))}
            for i, salt in enumerate((0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F)):
                hashes[i].append(min((x * salt & 0xFFFFFFFF) ^ (x >> 15) for x in runs))
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "text", "y")), *(pa.array(h, pa.int64()) for h in hashes)], names=["doc_id", "text", "y", "h0", "h1", "h2", "h3"])


def distinct_sample(sample: DataFrame) -> DataFrame:
    """The sample without most copies of a text: of those that share a min-hash and a label the smallest id stays."""
    rows = arrow_map(sample.select("doc_id", "text", "y"), _apart, "doc_id bigint, text string, y int, h0 bigint, h1 bigint, h2 bigint, h3 bigint")
    for h in ("h0", "h1", "h2", "h3"):
        rows = rows.groupBy("y", h).agg(F.min(F.struct("doc_id", "text", *(x for x in ("h0", "h1", "h2", "h3") if x != h))).alias("r")).select("y", h, "r.*")
    return materialize(rows.select("doc_id", "text", "y"), "labelled")


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, rows: int = SAMPLE) -> dict:
    """{insults, stems, weights, bias} from labelled rows outside the held-out fold, ``rows`` of each class at most.

    Null ids and labels are left out, an id's labels and texts count once; an empty table gives the general words alone.
    """
    sample, share = sample_of(docs, labelled(docs, labels, "toxic", folds, held), rows)
    sample = distinct_sample(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sums: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist(), strict=True):
                sums[y].update(_terms(t))
            terms = [t for t in sums[1]] + [t for t in sums[0] if t not in sums[1]]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([sums[1][t] for t in terms], pa.int64()), pa.array([sums[0][t] for t in terms], pa.int64())], names=["term", "ones", "zeros"])

    totals = arrow_map(sample, count, "term string, ones bigint, zeros bigint").groupBy("term").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    n1, n0 = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.coalesce(F.sum(1 - F.col("y")), F.lit(0))).first()
    odds = F.ln((F.col("ones") + 0.5) / (n1 + 1)) - F.ln((F.col("zeros") + 0.5) / (n0 + 1))
    telling = totals.filter(F.col("ones") >= MIN_DOCS[0]).withColumn("odds", odds).filter(F.col("odds") >= ODDS)
    top = telling.orderBy(F.desc(F.col("ones") * F.col("odds")), "term").collect()  # terms of the sample's toxic documents
    counts = {r.term: (r.ones, r.zeros) for r in top}
    names = set(counts)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = ["\n".join(sorted(_terms(t) & names)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, pa.string())], names=["doc_id", "terms"])

    toxic = arrow_map(sample.filter("y = 1"), pick, "doc_id bigint, terms string").distinct().collect()
    words, stems = learn_lexicon(counts, [set(r.terms.split("\n")) for r in toxic], n1, n0)
    model = {"insults": words, "stems": stems}

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, machine = Lexicon(words, stems), grammar()
        for b in slices(batches):
            x = [vector(matches(t, lexicon, machine)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = sorted(arrow_map(sample, features, "doc_id bigint, y int, x array<double>").collect())
    x = np.array([r.x for r in got]).reshape(len(got), PRIOR.size)
    model["weights"], model["bias"] = fit_weights(x, np.array([r.y for r in got], float), share)
    return model


def score(model: dict, found: list[tuple[int, int, str, str, float]]) -> float:
    z = float(np.dot(model["weights"], vector(found))) + model["bias"]
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def classify(docs: DataFrame, model: dict, threshold: float = 0.3) -> DataFrame:
    """``docs`` with score, predicted (1 from ``threshold`` on) and matches, the matched clauses' words with their kinds.

    A null or empty text matches nothing and has the score of the bias. Rows are independent; repeated rows keep their
    count; an empty table gives an empty one. Columns named score, predicted or matches are replaced; others stay.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        lexicon, machine = Lexicon(m["insults"], m["stems"]), grammar()
        for b in slices(batches):
            p, listed = [], []
            for t in b.column("text").to_pylist():
                found = matches(t, lexicon, machine) if t else []
                p.append(score(m, found))
                listed.append([{"start": s, "end": e, "what": what, "word": w} for s, e, what, w, _ in found])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("what", pa.string()), ("word", pa.string())]))
            arrays = [b.column(f) for f in b.schema.names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(p, pa.float64()), pa.array([int(x >= threshold) for x in p], pa.int32()), pa.array(listed, kind)], names=[*b.schema.names, "score", "predicted", "matches"])

    rows = docs.drop("score", "predicted", "matches")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return arrow_map(rows, run, f"{kinds}, score double, predicted int, matches array<struct<start: int, end: int, what: string, word: string>>")
