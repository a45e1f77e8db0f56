"""BPE encoding and decoding by a deterministic tokenization automaton.

The automaton reads token labels; its state is the last label. It starts with one state and a loop for each byte. Each
merge (a, b) -> c, in rank order, is a gadget that rewrites it:

* the arc b leaves the state of a (the pair can't stand side by side any more),
* an arc c enters wherever an arc a entered, and
* the state of c starts with the arcs that the state of b has just then.

With a = b the leftmost pair goes first, so an arc c doesn't leave the state of a. The finished automaton accepts one
path for each byte string, the one that BPE yields.

50,000 gadgets make up to 2.5e9 arcs, so the compiled table holds the arcs that are missing, as runs. Labels are numbered
twice, both times in preorder: by the forest of their left halves and by that of their right halves, younger children
first. The labels that begin with b and were made from it after a gadget (a, b) then have consecutive left numbers, the
states that end with a and were made after it consecutive right numbers; so what a gadget takes away is one rectangle of
arcs, and its rows are shared by all later gadgets that copy them. Rectangles are laid out as runs of right number * labels
+ left number and merged; an arc is there if no run holds it.

Words are bytes, so the automaton is made deterministic over bytes, a state being the label that ends here and the labels
that are still open, each with the label before it. States are made when a word first needs them and kept in a transition
table. Encoding a pre-split word is a table look-up for each byte and a walk back over the labels that end where the next
one begins: exactly one label of the accepted path ends at each place, so nothing is searched or tried twice. Decoding emits
the bytes of the labels.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import arrow_map, kept, slices

#: Fixed values of the byte-level pre-tokenizer: its split pattern, and the printable code points that stand for bytes.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]

#: Entries of the word table beyond which it becomes the old one, which is still asked, and a new one is begun; of the
#: transition table, which is begun anew; letters of a word that is kept.
WORD_ENTRIES, STEP_ENTRIES, WORD_LETTERS = 300_000, 200_000, 64


def byte_symbols() -> dict[str, int]:
    """Code point -> byte: printable bytes stand for themselves, the rest for the code points from 256 on."""
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class MergeAutomaton:
    """The automaton of a list of merges; labels are numbered 0..255 for the bytes, then 256 + rank.

    A merge that names a string no label has, or two merges that both yield one string, raise ValueError.
    """

    #: Keys of a state that aren't bytes.
    LABEL, OPEN = -1, -2

    def __init__(self, merges: Iterable[tuple[bytes, bytes]]):
        self.text: list[bytes] = [bytes([b]) for b in range(256)]
        self.left: list[int] = [-1] * 256
        self.right: list[int] = [-1] * 256
        self.gadget: dict[tuple[int, int], int] = {}
        label = {t: i for i, t in enumerate(self.text)}
        self.live = live = [True] * 256
        for a, b in merges:
            if a not in label or b not in label:
                raise ValueError(f"no label for a half of the merge {a!r} {b!r}")
            x, y, new = label[a], label[b], len(self.text)
            # a gadget whose arc is gone already, or was never there, adds no path
            live.append(live[x] and live[y] and (x, y) not in self.gadget and self.unwound(x, y, new))
            self.gadget.setdefault((x, y), new)
            self.text.append(a + b)
            self.left.append(x)
            self.right.append(y)
            if live[new] and live[label.get(a + b, new)] and a + b in label:
                raise ValueError(f"two merges make {a + b!r}; the automaton needs one label a string")
            if live[new] or a + b not in label:
                label[a + b] = new
        self._compile()
        self.next: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for i, t in enumerate(self.text):
            if not live[i]:
                continue
            node = 0
            for byte in t:
                step = self.next[node]
                if byte not in step:
                    step[byte] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                node = step[byte]
            self.ends[node] = i
        self._begin()

    def unwound(self, state: int, label: int, before: int) -> bool:
        """Whether the state has this arc after the gadgets numbered below ``before``, by undoing them, newest first."""
        left, right, gadget = self.left, self.right, self.gadget
        while True:
            if gadget.get((state, label), before) < before:
                return False
            newest = max(state, label)
            if newest < 256:
                return True
            if label == newest and left[label] == right[label] == state:
                return False
            before = newest
            if state == newest:
                state = right[state]
            if label == newest:
                label = left[label]

    def _preorder(self, parent: list[int]) -> tuple[list[int], list[int], list[list[int]]]:
        """(number, number behind its subtree, children) of each live label in a forest, younger children first."""
        children: list[list[int]] = [[] for _ in parent]
        size = [1] * len(parent)
        for i in range(len(parent) - 1, 255, -1):
            if self.live[i]:
                children[parent[i]].append(i)
                size[parent[i]] += size[i]
        at = [0] * len(parent)
        done = 0
        for root in range(256):
            at[root] = done
            done += size[root]
        for i, of in enumerate(children):  # a parent is older than its children, so its number is known
            here = at[i] + 1
            for c in of:
                at[c] = here
                here += size[c]
        return at, [a + n for a, n in zip(at, size, strict=True)], children

    def _compile(self) -> None:
        """Lay the arcs that gadgets take away out as merged runs."""
        begin, begin_end, begin_of = self._preorder(self.left)
        finish, finish_end, finish_of = self._preorder(self.right)

        def younger(at: list[int], end: list[int], children: list[list[int]], root: int, than: int) -> tuple[int, int]:
            """The numbers of a label and of what was made from it after ``than``."""
            of = children[root]
            k = bisect_left(of, -than, key=lambda c: -c)
            return at[root], at[of[k]] if k < len(of) else end[root]

        rows: list[tuple[int, int, int, int]] = []
        for (a, b), new in self.gadget.items():
            if not self.live[new]:
                continue
            states = younger(finish, finish_end, finish_of, a, new)
            rows.append((*states, *younger(begin, begin_end, begin_of, b, new)))
            if a == b:
                rows.append((*states, begin[new], begin_end[new]))
        self.width = len(self.text)
        self.begin, self.row = begin, [x * self.width for x in finish]
        top, below, first, end = np.array(rows, np.int64).reshape(-1, 4).T
        high = below - top
        row = np.repeat(top, high) + np.arange(high.sum()) - np.repeat(np.cumsum(high) - high, high)
        lo = row * self.width + np.repeat(first, high)
        hi = row * self.width + np.repeat(end, high)
        order = np.argsort(lo, kind="stable")
        lo, hi = lo[order], np.maximum.accumulate(hi[order])
        new_run = np.ones(lo.size, bool)
        new_run[1:] = lo[1:] > hi[:-1]
        last = np.append(new_run[1:], True)[: lo.size]
        self.gone, self.back = array("q", lo[new_run].tobytes()), array("q", hi[last].tobytes())

    def arc(self, state: int, label: int) -> bool:
        """Whether the arc is in the table; state -1 is the start of a word, where every live label may stand."""
        if state < 0:
            return True
        at = self.row[state] + self.begin[label]
        run = bisect_right(self.gone, at) - 1
        return run < 0 or at >= self.back[run]

    def _begin(self) -> None:
        self.states: dict[tuple, dict] = {}
        self.steps = 0
        self.start = self._state(-1, ((0, -1),))

    def _state(self, label: int, opened: tuple) -> dict:
        """A state: its arcs by byte; under LABEL the label that ends there, under OPEN what is open, as pairs (node of the
        labels' trie, label before)."""
        key = (label, opened)
        state = self.states.get(key)
        if state is None:
            state = self.states[key] = {self.LABEL: label, self.OPEN: opened}
        return state

    def _step(self, state: dict, byte: int) -> dict:
        nexts, ends = self.next, self.ends
        label, opened = -1, []
        for node, before in state[self.OPEN]:
            below = nexts[node]
            if byte in below:
                node = below[byte]
                if nexts[node]:
                    opened.append((node, before))
                if label < 0 and ends[node] >= 0 and self.arc(before, ends[node]):
                    label = ends[node]
        opened.append((0, label))
        if self.steps >= STEP_ENTRIES:
            self._begin()
        self.steps += 1
        new = state[byte] = self._state(label, tuple(opened))
        return new

    def encode(self, word: bytes) -> list[int]:
        """The labels of the accepted path."""
        state, passed = self.start, []
        add = passed.append
        for byte in word:
            state = state.get(byte) or self._step(state, byte)
            add(state)
        text, key, out, at = self.text, self.LABEL, [], len(word)
        while at:
            label = passed[at - 1][key]
            out.append(label)
            at -= len(text[label])
        out.reverse()
        return out

    def decode(self, labels: Iterable[int]) -> bytes:
        return b"".join(map(self.text.__getitem__, labels))


class ByteBpe:
    """Codec of a byte-level BPE tokenizer file: special strings, split pattern, automaton, ids.

    Files that ask for anything else (a normalizer, another pre-tokenizer, a prefix space, dropout, marked words, byte
    fallback, special strings that take white space with them) raise ValueError.
    """

    def __init__(self, spec: dict):
        model, before, after = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
        odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
        odd += [k for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized") if t.get(k)]
        if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or odd:
            raise ValueError(f"not plain byte-level BPE: {odd or spec.get('normalizer') or model['type']}")
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True) or after.get("type") != "ByteLevel":
            raise ValueError(f"not the byte-level pre-tokenizer and decoder: {before}, {after}")
        symbols = byte_symbols()
        raw = lambda s: bytes(symbols[c] for c in s)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.auto = MergeAutomaton((raw(a), raw(b)) for a, b in merges)
        ids = {raw(t): i for t, i in model["vocab"].items() if all(c in symbols for c in t)}
        self.ids = [ids[t] for t in self.auto.text]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        emit = {i: t for t, i in ids.items()} | {i: s.encode() for s, i in self.special.items()}
        self.emit = pa.array([emit.get(i) for i in range(max(emit) + 1)], pa.large_binary())
        self.split = regex.compile(SPLIT).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if longest_first else None
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @classmethod
    def from_json(cls, text: str) -> ByteBpe:
        return cls(json.loads(text))

    def _word(self, word: str) -> bytes:
        out = self.old.get(word)
        if out is None:
            ids = self.ids
            out = array("I", [ids[x] for x in self.auto.encode(word.encode("utf-8", "surrogatepass"))]).tobytes()
        if len(word) <= WORD_LETTERS:
            if len(self.words) >= WORD_ENTRIES:
                self.words, self.old = {}, self.words
            self.words[word] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids, as little-endian unsigned 32-bit integers."""
        out = []
        for part in self.cut(text) if self.cut and any(s in text for s in self.special) else (text,):
            if part in self.special:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                words = self.split(part)
                ids = list(map(self.words.get, words))
                if None in ids:
                    ids = [self._word(w) if x is None else x for w, x in zip(words, ids, strict=True)]
                out += ids
        return b"".join(out)

    def decode_all(self, ids: list[bytes]) -> list[str]:
        """The texts of many lists of ids; an id that no label has raises ValueError."""
        flat = np.frombuffer(b"".join(ids), "<u4")
        if not flat.size:
            return [""] * len(ids)
        arcs = self.emit.take(pa.array(flat))
        if arcs.null_count:
            raise ValueError("an id without a label")
        _, offsets, data = arcs.buffers()
        places = np.frombuffer(offsets, np.int64, len(arcs) + 1, arcs.offset * 8)
        cuts = places[np.cumsum([0, *(len(x) // 4 for x in ids)])].tolist()
        emitted = memoryview(data)
        return [str(emitted[a:b], "utf-8", "replace") for a, b in zip(cuts, cuts[1:])]  # noqa: B905

    def decode(self, ids: bytes) -> str:
        return self.decode_all([ids])[0]


def codec(spec: str) -> ByteBpe:
    """The codec of a tokenizer file's text; a worker builds it once."""
    return kept(f"{__name__}:{hash(spec)}", lambda: ByteBpe.from_json(spec))


def bpe_codec(docs: DataFrame, tokenizer_path: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Encode and decode every text: ``(id, ids binary, n_tokens, decoded)``.

    A null text counts as empty, has no ids and decodes to "". Rows are independent, so repeated rows and ties keep
    their count, an empty table gives an empty one, and other columns of the input are ignored whatever their names.
    The tokenizer file (a few MB, whatever the data) is read once on the driver and broadcast.
    """
    spec = docs.sparkSession.sparkContext.broadcast(_read(tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(spec.value)
        for b in slices(batches):
            ids = [bpe.encode(t) if t else b"" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(bpe.decode_all(ids), pa.string())],
                names=["id", "ids", "n_tokens", "decoded"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, f"id {kind}, ids binary, n_tokens bigint, decoded string").withColumnRenamed("id", id_col)


def _read(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def digest(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of what bpe_codec returns."""
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
