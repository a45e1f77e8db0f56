"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target token proportions.

Each source is a queue of its documents' tokens. A round is worth one window: queue s earns a credit of
c_s = 4096 * w_s / sum(w) tokens, spends the whole part and carries the rest, its deficit, to the next round; so every
4096 tokens of the stream hold each source's share to within two tokens; of hundreds of sources, whose parts of tokens
put rounds out of step with windows, to within its part of a round. When a queue runs dry the others share its part. The
rounds' outputs follow each other and are cut into windows.

What a queue has spent after k rounds is floor(c_s * k), so a token's place in the stream has a closed form that only
needs the queues' totals. Partitions therefore place their own tokens and still carry the deficits of all partitions
before them; no data are sorted or moved. The last window is cut into powers of two, so nothing is padded.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator, Mapping
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.bpe import _read
from engram.llm.common import arrow_map, kept, slices
from engram.session import materialize

WINDOW, END_ID = 4096, 2
#: Rows of a table that is broadcast; bits after a credit's point; figures that a layout keeps or makes at a time.
BROADCAST_ROWS, POINT, FIGURES = 200_000, 16, 1 << 20
#: Entries of a worker's table after which it becomes the old one, which is still asked, and a new one is begun; bytes of
#: text that are encoded at a time.
ENTRIES, SLICE = 200_000, 1 << 20

# ---- tokens ---------------------------------------------------------------------------------------------------------


class WordTokens:
    """Ids of whole texts as the tokenizer file gives them, by way of a table of words.

    It serves files whose normalizer is NFC, white space to one space and lower case, whose words are what WORDS finds, and
    whose words end in a marked token; so no token crosses words and the ids of many words can be told apart. Other files,
    and texts with special strings, are encoded whole.

    Words are found in array operations over the code points of many texts and told apart, byte for byte, by an Arrow
    dictionary; the table is asked once for each distinct word, only new ones reach the tokenizer, and the ids of all words
    are gathered by the dictionary's indices.
    """

    #: Fixed value: the words' pattern in the file.
    WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    OTHER, LETTER, NUMBER, SPACE = range(4)
    #: A letter whose lower case depends on its place.
    SIGMA = "\u03a3"

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.spec = spec
        j = json.loads(spec)
        self.special = [x["content"] for x in j.get("added_tokens", [])]
        norm = [(x["type"], x.get("content")) for x in (j.get("normalizer") or {}).get("normalizers", [])]
        pre = (j.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        suffix = j["model"].get("end_of_word_suffix")
        split = pre[0].get("type") == "Split" and pre[0].get("behavior") == "Removed" and pre[0].get("pattern") == {"Regex": self.WORDS}
        self.simple = bool(suffix) and norm == [("NFC", None), ("Replace", " "), ("Lowercase", None)] and split
        size = max([*j["model"]["vocab"].values(), *(x["id"] for x in j.get("added_tokens", []))]) + 1
        #: The type of ids: 2 bytes if all fit.
        self.type = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        if self.simple:
            words = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *pre[1:]]}
            self.words = Tokenizer.from_str(json.dumps(j | {"normalizer": None, "pre_tokenizer": words, "added_tokens": []}))
            self.ends = np.zeros(size, bool)
            self.ends[[i for t, i in j["model"]["vocab"].items() if t.endswith(suffix)]] = True
            every = "".join(map(chr, range(0xD800))) + " " * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
            self.kinds = np.full(0x110000, self.OTHER, np.uint8)
            for kind, pattern in ((self.LETTER, r"\p{L}+"), (self.NUMBER, r"\p{N}+"), (self.SPACE, r"\s+")):
                for m in regex.finditer(pattern, every):
                    self.kinds[m.start() : m.end()] = kind
            self.kinds[0xD800:0xE000] = self.OTHER
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @cached_property
    def whole(self):
        """The file's own tokenizer, made when the first text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.spec)

    def _learn(self, words: list[bytes]) -> None:
        for at in range(0, len(words), 4000):
            part = words[at : at + 4000]
            made = self.words.encode_batch_fast([b" ".join(part).decode("utf-8", "surrogatepass")], add_special_tokens=False)[0]
            ids = np.array(made.ids, self.type)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if cuts.size != len(part):
                raise ValueError("the words' ends can't be told from their ids")
            raw, ends = ids.tobytes(), (cuts * ids.itemsize).tolist()
            self.known.update(zip(part, [raw[i:j] for i, j in zip([0, *ends], ends)], strict=True))

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of distinct words."""
        if len(self.known) > ENTRIES:
            self.known, self.old = {}, self.known
        known, old = self.known, self.old
        out = list(map(known.get, words))
        missing = [i for i, x in enumerate(out) if x is None]
        new = []
        for i in missing:
            x = old.get(words[i])
            if x is None:
                new.append(words[i])
            else:
                known[words[i]] = x
        self._learn(new)
        for i in missing:
            out[i] = known[words[i]]
        return out

    def _cut(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, end) of the words in code points, in order; they fill all that isn't white space."""
        kind = self.kinds[codes]
        new = np.ones(codes.size, bool)
        np.not_equal(kind[1:], kind[:-1], out=new[1:])
        new |= kind == self.NUMBER
        at = np.flatnonzero(new)
        full = kind[at] != self.SPACE
        first, end = at[full], np.append(at[1:], codes.size)[full]
        # a mark that is a lone ' takes the letters of a contraction from the word behind it
        mark = np.flatnonzero((codes[first] == ord("'")) & (end - first == 1) & (end < codes.size))
        mark = mark[kind[end[mark]] == self.LETTER]
        if mark.size:
            x = codes[end[mark]]
            y = codes[np.minimum(end[mark] + 1, codes.size - 1)]
            is_in = lambda letters: np.isin(x, [ord(c) for c in letters])
            two = ((x == ord("r")) | (x == ord("v"))) & (y == ord("e")) | (x == ord("l")) & (y == ord("l"))
            taken = np.where(is_in("stmd"), 1, np.where(two, 2, 0))
            end[mark] += taken
            first[mark + 1] += taken
            full = first < end
            first, end = first[full], end[full]
        return first, end

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids start and the last one's end)."""
        joined = "\n".join(texts) + "\n"
        narrow = joined.isascii()
        codes = np.frombuffer(joined.encode("ascii"), np.uint8) if narrow else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
        first, end = self._cut(codes)
        if not first.size:
            return np.zeros(0, self.type), np.zeros(len(texts) + 1, np.int64)
        # the words' bytes side by side, and where each begins
        solid = codes[self.kinds[codes] != self.SPACE].tobytes()
        upto = np.concatenate([[0], np.cumsum(end - first)])
        if not narrow:
            solid = solid.decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            starts = np.flatnonzero((np.frombuffer(solid, np.uint8) & 0xC0) != 0x80)
            upto = np.append(starts, len(solid))[upto]
        large = len(solid) >= 1 << 31
        kind, offsets = (pa.large_binary(), upto.astype(np.int64)) if large else (pa.binary(), upto.astype(np.int32))
        words = pa.Array.from_buffers(kind, first.size, [None, pa.py_buffer(offsets), pa.py_buffer(solid)]).dictionary_encode()
        ids = pa.array(self._ids(words.dictionary.to_pylist()), pa.large_binary()).take(words.indices)
        _, offsets, data = ids.buffers()
        cuts = np.frombuffer(offsets, np.int64, len(ids) + 1, ids.offset * 8) // self.type.itemsize
        flat = np.frombuffer(data, self.type, int(cuts[-1]))
        texts_at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)])
        return flat, cuts[np.searchsorted(first, texts_at)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        plain, whole = [], []
        for i, t in enumerate(texts):
            if not self.simple or ("<|" in t and any(s in t for s in self.special)):
                whole.append(i)
                continue
            if not t.isascii():
                if not unicodedata.is_normalized("NFC", t):
                    t = unicodedata.normalize("NFC", t)
                if self.SIGMA in t:
                    t = t.replace(self.SIGMA, self.SIGMA.lower())
            plain.append(t.lower())
        ids, at = self._plain(plain) if plain else (np.zeros(0, self.type), np.zeros(1, np.int64))
        out = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for i in whole:
            out.insert(i, np.array(self.whole.encode(texts[i], add_special_tokens=False).ids, self.type))
        return out


def word_tokens(spec: str) -> WordTokens:
    return kept(f"{__name__}:{hash(spec)}", lambda: WordTokens(spec))


# ---- rounds ---------------------------------------------------------------------------------------------------------


def _stretches(totals: list[int], weights: list[float] | None, window: int) -> Iterator[dict]:
    bits = 20 + len(totals).bit_length()
    scale = [int(w * (1 << bits)) for w in weights] if weights else list(totals)
    most = (window << POINT) * max([*scale, 1])
    # whole numbers of any size where 64 bits don't hold a product
    scale = np.maximum(np.array(scale, np.int64 if most < 1 << 63 else object), 1)
    left, pos = np.array(totals, np.int64), 0
    spent = np.zeros_like(left)
    while left.any():
        live = np.flatnonzero(left)
        scales = scale[live]
        credit = np.zeros_like(left)
        credit[live] = np.maximum((window << POINT) * scales // sum(scales.tolist()), 1)
        rounds = int((-(-(left[live] << POINT) // credit[live])).min())
        yield {"pos": pos, "start": spent.copy(), "left": left.copy(), "credit": credit, "rounds": rounds}
        n = np.minimum(credit * rounds >> POINT, left)
        left, spent, pos = left - n, spent + n, pos + int(n.sum())


def phases(totals: list[int], weights: list[float] | None = None, window: int = WINDOW) -> list[dict]:
    """The stretches between which queues run dry: {pos, start, left, credit, rounds}, lists by queue.

    pos: where the stretch starts in the stream; start, left: what each queue has spent and still holds then; credit: its
    tokens a round with POINT binary digits, 0 when dry. Without weights the targets are the totals' own proportions.
    """
    return [{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in p.items()} for p in _stretches(totals, weights, window)]


class Layout:
    """Places of the queues' tokens in the stream and in the sequences."""

    def __init__(self, totals: list[int], weights: list[float] | None = None, window: int = WINDOW):
        self.totals, self.weights, self.window, self.total = totals, weights, window, sum(totals)
        self.kept: list[dict] | None = None
        self.full = self.total // window
        # the last tokens: sequences of falling powers of two
        rest, at, self.tails = self.total % window, self.full * window, []
        for bit in range(window.bit_length() - 1, -1, -1):
            if rest >> bit & 1:
                self.tails.append((at, 1 << bit))
                at += 1 << bit

    def _phases(self) -> Iterator[dict]:
        """The phases: kept if they are few figures, else made again, as many queues may have as many phases."""
        if self.kept is not None:
            yield from self.kept
            return
        kept, size = [], 0
        for p in _stretches(self.totals, self.weights, self.window):
            size += len(self.totals)
            if size <= FIGURES:
                kept.append(p)
            yield p
        if size <= FIGURES:
            self.kept = kept

    def stretches(self, queue: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, queue offset, stream position, length) of the pieces that the rounds make of each [begin, end) of a queue."""
        parts = []
        for p in self._phases():
            first, credit = p["start"][queue], p["credit"][queue]
            upto = np.minimum(p["left"][queue], credit * p["rounds"] >> POINT)
            lo, hi = np.maximum(begin - first, 0), np.minimum(end - first, upto)
            rows = np.flatnonzero((lo < hi) & (credit > 0))
            if not rows.size:
                continue
            q, lo, hi, c = queue[rows], lo[rows], hi[rows], credit[rows]
            k0 = -(-((lo + 1) << POINT) // c) - 1
            # the rounds that a row meets; where a round is worth less than a token, those of its tokens
            slow = c < 1 << POINT
            n = np.where(slow, hi - lo, -(-(hi << POINT) // c) - k0)
            at = np.repeat(np.arange(rows.size), n)
            i = np.arange(at.size) - np.repeat(np.cumsum(n) - n, n)
            k = np.where(slow[at], -(-((lo[at] + i + 1) << POINT) // c[at]) - 1, k0[at] + i)
            own, most = (np.minimum(c[at] * (k + j) >> POINT, p["left"][q[at]]) for j in (0, 1))
            head = p["pos"] + self._heads(p, k, q[at])
            x, y = np.maximum(own, lo[at]), np.minimum(most, hi[at])
            ok = y > x
            parts.append((rows[at][ok], (x + first[rows][at])[ok], (head + x - own)[ok], (y - x)[ok]))
        if not parts:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        row, x, at, n = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((x, row))
        return row[order], x[order], at[order], n[order]

    @staticmethod
    def _heads(p: dict, k: np.ndarray, q: np.ndarray) -> np.ndarray:
        """What all queues have spent in a phase before queue q's turn in its round k."""
        live = np.flatnonzero(p["credit"])
        credit, left = p["credit"][live], p["left"][live]
        turn, out = np.searchsorted(live, q), np.empty(k.size, np.int64)
        order = np.argsort(k, kind="stable")
        rounds, first = np.unique(k[order], return_index=True)
        first, step = np.append(first, k.size), max(1, FIGURES // live.size)
        for a in range(0, rounds.size, step):
            part = rounds[a : a + step]
            before = np.minimum(part[:, None] * credit >> POINT, left)
            own = np.minimum((part[:, None] + 1) * credit >> POINT, left) - before
            # turns before one's own have had this round
            head = before.sum(axis=1)[:, None] + np.cumsum(own, axis=1) - own
            rows = order[first[a] : first[a + part.size]]
            out[rows] = head[np.searchsorted(part, k[rows]), turn[rows]]
        return out

    def place(self, queue: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, queue offset, length, sequence, offset) of the pieces of each [begin, end) of a queue, in order."""
        row, x, at, n = self.stretches(queue, begin, end)
        edges = np.array([a for a, _ in self.tails], np.int64)
        full = self.full * self.window
        # cut at the sequences' starts, a piece being no longer than a round and a round than a window
        while True:
            left = np.where(at < full, self.window - at % self.window, 0)
            if edges.size:
                i = np.maximum(np.searchsorted(edges, at, "right") - 1, 0)
                left = np.where(at < full, left, edges[i] + np.array([m for _, m in self.tails])[i] - at)
            long = np.flatnonzero(n > left)
            if not long.size:
                break
            row, x = np.insert(row, long + 1, row[long]), np.insert(x, long + 1, (x + left)[long])
            more, next_at = (n - left)[long], (at + left)[long]
            n[long] = left[long]
            n, at = np.insert(n, long + 1, more), np.insert(at, long + 1, next_at)
        seq, off = at // self.window, at % self.window
        if edges.size:
            tail = at >= full
            i = np.maximum(np.searchsorted(edges, at, "right") - 1, 0)
            seq, off = np.where(tail, self.full + i, seq), np.where(tail, at - edges[i], off)
        if not row.size:
            return row, x, n, seq, off
        # rounds of a queue that is alone follow each other
        new = np.ones(row.size, bool)
        new[1:] = (row[1:] != row[:-1]) | (seq[1:] != seq[:-1]) | (at[1:] != at[:-1] + n[:-1]) | (x[1:] != x[:-1] + n[:-1])
        keep = np.flatnonzero(new)
        return row[keep], x[keep], np.add.reduceat(n, keep), seq[keep], off[keep]

    def pieces(self, queue: int, begin: int, end: int) -> list[tuple[int, int, int, int]]:
        """(queue offset, length, sequence, offset) of the pieces of one [begin, end)."""
        found = self.place(*(np.array([v], np.int64) for v in (queue, begin, end)))
        return list(zip(*(c.tolist() for c in found[1:]), strict=True))


# ---- the operator ---------------------------------------------------------------------------------------------------


def pack(docs: DataFrame, tokenizer_path: str, targets: Mapping[str, float] | None = None, source_col: str = "source", window: int = WINDOW) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source) of all documents' tokens.

    A document's tokens are the tokenizer's ids of its whole text and END_ID. A null text is empty and has END_ID only;
    a null source is a queue of its own, the key None of ``targets``. Repeated rows and ids are packed as often as they stand. An empty table gives an
    empty one; other columns are ignored. ``targets``: weights of sources, 0 or missing ones going last by a weight of
    next to nothing; without it the sources' own proportions, which then hold to the end. Each source has a queue,
    however many there are, so a window holds the proportions of them all and ``targets`` are those of sources.

    Tokens are made once and written to the shared folder with their place in their partition's queues, so that a retry
    reads the same places. Queue totals, one a source, are the only figures that reach the driver and each task; a batch's
    places take time by sources times the rounds that the batch meets.
    """
    spark = docs.sparkSession
    spec = spark.sparkContext.broadcast(_read(tokenizer_path))
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))  # '' is the null source's
    kind = docs.schema["doc_id"].dataType.simpleString()

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, pid, reach = word_tokens(spec.value), TaskContext.get().partitionId(), {}
        for b in slices(batches, limit=SLICE):
            ids = made.encode([t or "" for t in b.column("text").to_pylist()])
            # ids of 2 bytes, or, marked by an odd length, 4
            mark, end = b"" if made.type.itemsize == 2 else b"\0", np.array([END_ID], made.type).tobytes()
            narrow = [mark + x.tobytes() + end for x in ids]
            n = [x.size + 1 for x in ids]
            starts = []
            for q, size in zip(b.column("queue").to_pylist(), n, strict=True):
                starts.append(reach.get(q, 0))
                reach[q] = starts[-1] + size
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("queue"), pa.array([pid] * b.num_rows, pa.int32()), pa.array(starts, pa.int64()), pa.array(n, pa.int64()), pa.array(narrow, pa.binary())], names=["doc_id", "queue", "pid", "begin", "n", "ids"])

    rows = docs.select("doc_id", "text", source.alias("queue"))
    made = materialize(arrow_map(rows, tokens, f"doc_id {kind}, queue string, pid int, begin bigint, n bigint, ids binary"), "tokens", 8 << 20)
    sums = made.groupBy("queue", "pid").agg(F.sum("n").alias("sum_n"))
    bases = sums.withColumn("base", F.sum("sum_n").over(Window.partitionBy("queue").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)))
    bases = bases.select("queue", "pid", F.coalesce("base", F.lit(0)).alias("base"))
    totals = {r.queue: r.n for r in sums.groupBy("queue").agg(F.sum("sum_n").alias("n")).collect()}
    names = sorted(totals)
    weights = [targets.get(q[1:] if q else None, 0.0) for q in names] if targets else None
    layout = spark.sparkContext.broadcast((names, [totals[q] for q in names], weights, window))
    if bases.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, totals, weights, window = layout.value
        at, plan = {q: i for i, q in enumerate(names)}, Layout(totals, weights, window)
        for b in slices(batches, "ids"):
            q, n, ids = (b.column(c) for c in ("queue", "n", "ids"))
            size = n.to_numpy()
            zero = b.column("base").to_numpy() + b.column("begin").to_numpy()
            queue = np.array([at[x] for x in q.to_pylist()], np.int64)
            row, x, length, seq, off = plan.place(queue, zero, zero + size)
            x = x - zero[row]
            # 2 bytes an id, or, marked by an odd length, 4
            raw = [np.frombuffer(v, "<u2").astype("<u4").tobytes() if len(v) == 2 * m else v[1:] for v, m in zip(ids.to_pylist(), size.tolist(), strict=True)]
            crc = [zlib.crc32(raw[i][4 * s : 4 * e]) for i, s, e in zip(row.tolist(), x.tolist(), (x + length).tolist(), strict=True)]
            pick = pa.array(row)
            source = pa.array([v[1:] if v else None for v in names], pa.string()).take(pa.array(queue[row]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pick), pa.array(x), pa.array(length), pa.array(crc, pa.int64()), n.take(pick), pa.array(seq), pa.array(off), source], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    out = f"doc_id {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, source string"
    return arrow_map(made.join(bases, ["queue", "pid"]).select("doc_id", "queue", "base", "begin", "n", "ids"), place, out)
