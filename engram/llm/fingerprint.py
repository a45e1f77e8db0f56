"""Locally consistent parsing: deterministic coin tossing builds hierarchical phrase names.

A text is a sequence of symbols, its code points. One level of parsing
1. joins runs of a symbol, so that neighbours differ,
2. tosses coins: a symbol becomes 2 * i + b, i being the lowest bit in which it differs from its left neighbour and b
   its own bit there; neighbours still differ, and after three tosses a label is below 8,
3. starts a phrase at each label larger than both neighbours, and
4. names each phrase by a hash of its symbols; the names are the next level's symbols.
Whether a phrase starts at a place depends on a few symbols around it, so equal substrings are cut and named alike but
for their margins, wherever they stand. A level's phrases span about three to four of the level below.

The fingerprint is a one-permutation min-hash (64 bins of 16 bits) of the set of names of one level.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.llm.common import arrow_map, slices

BINS, EMPTY, LEVEL, TOSSES = 64, 0xFFFF, 3, 3
SLICE = 4 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit scramble."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _toss_table() -> np.ndarray:
    """(left, own) labels below 128 -> the coin's label; 0 for equal ones, which only a text's start has."""
    left, own = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    low = np.bitwise_count(((left ^ own) & -(left ^ own)) - 1).astype(np.int64) & 7
    return np.where(left == own, 0, 2 * low + ((own >> low) & 1)).astype(np.uint8).ravel()


_TOSS = _toss_table()
_WEIGHTS = mix(np.arange(1, 257)) | np.uint64(1)


def _first_toss(symbols: np.ndarray, top: np.ndarray) -> np.ndarray:
    left = np.empty_like(symbols)
    left[1:] = symbols[:-1]
    left[top] = ~symbols[top]  # differs in bit 0
    left ^= symbols
    one = symbols.dtype.type(1)
    low = np.bitwise_count((left & (~left + one)) - one)
    own = (symbols >> low.astype(symbols.dtype)).astype(np.uint8) & np.uint8(1)
    return (low & np.uint8(63)) * np.uint8(2) + own


def parse_level(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One level over texts laid end to end. ``first``: where each text starts (no text is empty).

    Returns the phrases' names, where each text's phrases start, and where each phrase starts among the symbols.
    """
    n = symbols.size
    starts = np.empty(n, bool)
    starts[1:] = symbols[1:] != symbols[:-1]
    starts[first] = True
    run = np.flatnonzero(starts)
    name, top = symbols, first
    if run.size < n:
        length = np.diff(run, append=n)
        name = symbols[run].astype(np.uint64)
        many = np.flatnonzero(length > 1)
        name[many] = mix(name[many] + length[many].astype(np.uint64) * _WEIGHTS[7])
        top = np.searchsorted(run, first)
    label = _first_toss(name, top)
    for _ in range(TOSSES - 1):
        pair = np.empty(label.size, np.uint16)
        pair[1:] = label[:-1]
        pair[top] = label[top] ^ np.uint8(1)
        label = _TOSS[(pair << np.uint16(7)) | label]
    cut = np.empty(label.size, bool)
    cut[1:] = label[1:] > label[:-1]
    falls = label[:-1] > label[1:]
    falls[top[1:] - 1] = True  # a text's end
    cut[:-1] &= falls
    cut[top] = True
    cut = np.flatnonzero(cut)
    place = np.arange(label.size, dtype=np.int32) - np.repeat(cut.astype(np.int32), np.diff(cut, append=label.size))
    names = mix(np.add.reduceat((name.astype(np.uint64) + np.uint64(1)) * _WEIGHTS[place & 255], cut)) >> np.uint64(1)
    return names, np.searchsorted(cut, top), run[cut]


def parse(texts: list[str], levels: int = LEVEL) -> tuple[np.ndarray, np.ndarray]:
    """(names of the phrases of the last level, the text of each); an empty text has none."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.flatnonzero(lengths)
    if not owner.size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    symbols = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    first = np.concatenate([[0], np.cumsum(lengths[owner])[:-1]])
    for _ in range(levels):
        symbols, first, _ = parse_level(symbols, first)
    return symbols, np.repeat(owner, np.diff(first, append=symbols.size))


def phrases(text: str, levels: int = LEVEL) -> list[list[tuple[int, int, int]]]:
    """The hierarchy of one text: for each level its phrases as (start, end, name), in code points."""
    if not text:
        return [[] for _ in range(levels)]
    symbols, first = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), np.zeros(1, np.int64)
    at, out = np.arange(symbols.size), []
    for _ in range(levels):
        symbols, first, cut = parse_level(symbols, first)
        at = at[cut]
        ends = np.append(at[1:], len(text))
        out.append(list(zip(at.tolist(), ends.tolist(), symbols.tolist(), strict=True)))
    return out


def sketches(texts: list[str], levels: int = LEVEL) -> np.ndarray:
    """(texts, 64) 16-bit minima; 0xFFFF marks a bin without a phrase."""
    names, owner = parse(texts, levels)
    h = mix(names + np.uint64(0x632BE59BD9B4E019))
    out = np.full(len(texts) * BINS, EMPTY, np.uint16)
    np.minimum.at(out, owner * BINS + (h >> np.uint64(58)).astype(np.int64), ((h & np.uint64(0xFFFFFFFF)) % np.uint64(EMPTY)).astype(np.uint16))
    return out.reshape(len(texts), BINS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the bins that hold a phrase on either side in which both agree; 1 for two texts without phrases."""
    used = ((a != EMPTY) | (b != EMPTY)).sum(axis=-1)
    same = ((a == b) & (a != EMPTY)).sum(axis=-1)
    return np.where(used == 0, 1.0, same / np.maximum(used, 1))


def to_hex(sketch: np.ndarray) -> list[str]:
    data, width = sketch.astype(">u2").tobytes().hex(), BINS * 4
    return [data[i * width : (i + 1) * width] for i in range(sketch.shape[0])]


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", levels: int = LEVEL) -> DataFrame:
    """(id, n_chars, fingerprint, n_phrases) of every whole text; null counts as empty, which has no phrases.

    Rows are independent: equal texts have equal fingerprints, repeated rows and ids keep their count, an empty table gives
    an empty one, and other columns are ignored whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, limit=SLICE):
            texts = [t or "" for t in b.column("text").to_pylist()]
            _, owner = parse(texts, levels)
            count = np.bincount(owner, minlength=len(texts))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(to_hex(sketches(texts, levels)), pa.string()), pa.array(count, pa.int64())], names=["id", "n_chars", "fingerprint", "n_phrases"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return arrow_map(rows, run, f"id {kind}, n_chars bigint, fingerprint string, n_phrases bigint").withColumnRenamed("id", id_col)


def chain(docs: DataFrame) -> DataFrame:
    """(bucket, id, text, ghost): rows dealt into ranges of falling id, each with the row that follows its last one.

    The edges are quantiles of the ids, a few numbers whatever the data. Rows of the same id stand by falling hash of the
    text; an id that is several quantiles, and the null ids, which come last, are split into ranges of this hash. The row that
    follows a range, the first of the next range that has rows (after the last: of the first), is one row and comes along as
    a ghost. Null texts count as empty.
    """
    spark = docs.sparkSession
    count = max(64, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.withColumn("hash", F.xxhash64("text"))
    found = docs.select(F.percentile_approx("id", [i / count for i in range(1, count)], 10_000).alias("e")).first().e
    times = Counter(found or [])
    edges = sorted(times, reverse=True)
    ladder = F.array(*(F.lit(e) for e in edges)).cast("array<bigint>")
    # an id stands at its range's end, as the ranges' lower edges are ids; of s parts a row has the one of its hash
    parts = F.lit(0)
    for e in edges:
        parts = F.when(F.col("id") == e, 2 * times[e]).otherwise(parts) if times[e] > 1 else parts
    parts = F.when(F.col("id").isNull(), count).otherwise(parts)
    place = F.when(F.col("id").isNull(), len(edges) + 1).otherwise(F.size(F.filter(ladder, lambda e: F.col("id") < e)))
    split = F.floor((32767 - F.shiftright("hash", 48)) * parts / 65536)
    bucket = place * (2 * count + 1) + F.when(parts > 0, split + 1).otherwise(0)
    rows = docs.select(bucket.cast("int").alias("bucket"), "id", "hash", "text")
    # the first row of each range: its id first, so that only the rows of that id compare texts
    tops = {r.bucket: r.id for r in rows.groupBy("bucket").agg(F.max("id").alias("id")).collect()}  # at most four rows a quantile
    order = sorted(tops)
    if not order:
        return rows.withColumn("ghost", F.lit(False))
    ahead = {b: order[i - 1] for i, b in enumerate(order)}  # the range to which b's first row goes as a ghost
    keys = spark.createDataFrame([(b, tops[b], ahead[b]) for b in order], "b int, top bigint, ahead int")
    ghosts = rows.join(F.broadcast(keys), (F.col("bucket") == F.col("b")) & F.col("id").eqNullSafe(F.col("top")))
    ghosts = ghosts.groupBy(F.col("ahead").alias("bucket"), "id").agg(F.max(F.struct("hash", "text")).alias("r")).select("bucket", "id", "r.*", F.lit(True).alias("ghost"))
    both = rows.withColumn("ghost", F.lit(False)).unionByName(ghosts)
    return both.repartitionByRange(len(order), "bucket").sortWithinPartitions("bucket", "ghost", F.desc_nulls_last("id"), F.desc("hash"), F.desc("text"))


def edited_fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", levels: int = LEVEL) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    The edited text: the last half of the code points gives way to the first as many of the next document, by falling
    id (after the last: the first; a single document follows itself). (id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next); likeness as ``likeness`` has it. A null text counts as empty; rows of
    the same id stand by falling hash of the text; an empty table gives an empty one; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []  # the last row of a slice waits for the next slice
        for b in slices(batches, limit=SLICE):
            rows = kept + list(zip(*(b.column(c).to_pylist() for c in ("bucket", "id", "text", "ghost")), strict=True))
            kept = rows[-1:] if not rows[-1][3] else []
            if len(rows) > 1:
                yield from block(rows)
        # a range ends with its ghost, so no row is left waiting

    def block(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        texts = [r[2] or "" for r in rows]
        own = [i for i, r in enumerate(rows[:-1]) if not r[3]]
        if not own:
            return
        edits = []
        for i in own:
            half = len(texts[i]) // 2
            edits.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
        s, e = sketches(texts, levels), sketches(edits, levels)
        at = np.array(own)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][1] for i in own], pa.int64()),
                pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edits], pa.string()),
                pa.array(to_hex(s[at]), pa.string()),
                pa.array(to_hex(e), pa.string()),
                pa.array(likeness(s[at], e), pa.float64()),
                pa.array(likeness(s[at], s[at + 1]), pa.float64()),
            ],
            names=["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    out = "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return arrow_map(chain(rows), run, out).withColumnRenamed("id", id_col)
