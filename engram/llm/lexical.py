"""Ranked lexical search over dual-sorted wavelet trees, one for each shard of documents.

A shard's postings lie one term after another, each term's by falling impact; the sequence of their documents (numbers in the
order of ids) is kept in a wavelet tree, whose nodes are ranges of ids. A stable partition keeps the order by impact in every
node, so a term's first posting there bounds what it adds to any document of the range. A search opens the nodes of the
greatest sum of bounds first, all terms side by side, until k documents are found that no open node can beat: the exact
top k. Nodes of one level are opened in groups, as array operations.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from engram.llm.common import BROADCAST_BYTES, arrow_map, is_small, slices
from engram.session import materialize

#: What parts terms: ASCII characters that are neither letters nor digits.
PARTS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Text of a shard, nodes opened at a time, and the id that stands for none among ties: it comes last.
SHARD_BYTES, GROUP, LAST = 8 << 20, 64, np.iinfo(np.int64).max
INDEX = "docs bigint, length bigint, ids array<bigint>, terms array<string>, starts array<int>, tree binary, impacts binary"
POSTINGS = "docs bigint, length bigint, ids array<bigint>, lengths array<int>, terms array<string>, starts array<int>, at binary, tf binary"


class DualSorted:
    """A wavelet tree over the sequence ``docs`` of numbers below ``size`` and their ``impacts``, falling within each term."""

    def __init__(self, bits: np.ndarray, impacts: np.ndarray, size: int):
        """``bits``: a row of booleans for each level, from the highest bit of the numbers to the lowest."""
        self.levels, self.size = len(bits), size
        self.zeros, self.impacts = [], [impacts]
        for b in bits:
            self.zeros.append(np.concatenate([[0], np.cumsum(~b)]).astype(np.int32))
            self.impacts.append(np.concatenate([self.impacts[-1][~b], self.impacts[-1][b]]))

    @staticmethod
    def bits(docs: np.ndarray, size: int) -> np.ndarray:
        levels = max(1, int(size - 1).bit_length())
        out = np.zeros((levels, len(docs)), bool)
        for i in range(levels):
            out[i] = docs >> (levels - 1 - i) & 1
            docs = np.concatenate([docs[~out[i]], docs[out[i]]])
        return out

    def children(self, level: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of positions below: the left children's rows, then the right ones'."""
        z = self.zeros[level]
        a, b = z[low], z[high]
        return np.concatenate([a, z[-1] + low - a]), np.concatenate([b, z[-1] + high - b])

    def bounds(self, level: int, low: np.ndarray, high: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The sum over terms of weight times the first posting's impact; of a single document, its score."""
        imp = self.impacts[level]
        return np.where(high > low, imp[np.minimum(low, len(imp) - 1)], 0) @ weights

    def top(self, low: np.ndarray, high: np.ndarray, weights: np.ndarray, k: int, ids: np.ndarray, best: list[tuple[int, int]] = (), every: bool = False) -> list[tuple[int, int]]:
        """The k greatest (score, -id) of ``best`` and of the documents with a score above 0; ``ids`` rise.

        low, high: each term's range of postings. every: only documents that have all terms.
        """
        best = list(best)
        floor = best[-1] if len(best) >= k else (0, -LAST - 1)
        if not len(low) or not len(self.impacts[0]):
            return best

        def open_(level, low, high, prefix):
            """Push groups of nodes that may hold a document to be found, greatest bound first."""
            bound = self.bounds(level, low, high, weights)
            first = ids[np.minimum(prefix << (self.levels - level), self.size - 1)]
            good = (bound > 0) & ((bound > floor[0]) | ((bound == floor[0]) & (-first > floor[1])))
            if every:
                good &= (high > low).all(axis=1)
            at = np.flatnonzero(good)
            at = at[np.argsort(-bound[at], kind="stable")]
            for i in range(0, len(at), GROUP):
                a = at[i : i + GROUP]
                heapq.heappush(heap, (-int(bound[a[0]]), -level, next(count), low[a], high[a], prefix[a], bound[a]))

        heap, count = [], iter(range(1 << 62))
        open_(0, low[None].astype(np.int64), high[None].astype(np.int64), np.zeros(1, np.int64))
        while heap:
            top, level, _, low, high, prefix, bound = heapq.heappop(heap)
            if -top < floor[0]:
                break
            if -level == self.levels:
                best = heapq.nlargest(k, best + [(int(s), -int(ids[p])) for s, p in zip(bound, prefix, strict=True)])
                floor = best[-1] if len(best) == k else floor
                continue
            keep = bound >= floor[0]
            low, high = self.children(-level, low[keep], high[keep])
            prefix = prefix[keep] << 1
            open_(-level + 1, low, high, np.concatenate([prefix, prefix | 1]))
        return best


def postings(docs: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """Shards of ``docs`` (doc_id, text): POSTINGS, of all terms or of ``terms`` only; lengths count all terms either way.

    A shard is a slice of a task's documents with SHARD_BYTES of text, or one longer text; nothing is shuffled. docs counts
    the documents with a term, length all their terms. Null texts have none; null ids stay, repeated rows are documents each.
    """
    sc = docs.sparkSession.sparkContext
    wanted = None if terms is None else sc.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None if wanted is None else pa.array(wanted.value, pa.string())
        for part in slices(batches, limit=SHARD_BYTES):
            ids = part.column("doc_id")
            order = np.argsort(pc.fill_null(ids, LAST).to_numpy(zero_copy_only=False), kind="stable")
            lists = pc.split_pattern_regex(pc.ascii_lower(pc.fill_null(part.column("text").take(pa.array(order)), "")), PARTS)
            at = lists.offsets.to_numpy()
            row, word = np.repeat(np.arange(len(order), dtype=np.int64), np.diff(at)), lists.values.slice(at[0], at[-1] - at[0])
            real = pc.not_equal(word, "")
            row, word = row[real.to_numpy(zero_copy_only=False)], word.filter(real)
            length = np.bincount(row, minlength=len(order))
            if own is None:
                coded = word.dictionary_encode()
                names, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
            else:
                names, code = own, pc.fill_null(pc.index_in(word, own), -1).to_numpy().astype(np.int64)
                row, code = row[code >= 0], code[code >= 0]
            key, tf = np.unique(code * len(order) + row, return_counts=True)
            code, row = key // len(order), key % len(order)
            first = np.flatnonzero(np.diff(code, prepend=-1))
            yield pa.RecordBatch.from_pylist(
                [{"docs": int((length > 0).sum()), "length": int(length.sum()), "ids": ids.take(pa.array(order)).to_pylist(), "lengths": length.tolist(), "terms": names.take(pa.array(code[first])).to_pylist(), "starts": [*first.tolist(), len(code)], "at": row.astype("<i4").tobytes(), "tf": tf.astype("<i4").tobytes()}],
                schema,
            )

    ints = pa.list_(pa.int32())
    kinds = [("docs", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", ints), ("terms", pa.list_(pa.string())), ("starts", ints), ("at", pa.binary()), ("tf", pa.binary())]
    schema = pa.schema(kinds)
    return arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), run, POSTINGS)


def document_counts(shards: DataFrame) -> DataFrame:
    """(term, df): the documents that hold a term, from shards of postings or of the index."""
    each = F.explode(F.arrays_zip("terms", F.slice("starts", 1, F.size("terms")).alias("a"), F.slice("starts", 2, F.size("terms")).alias("b")))
    return shards.select(each.alias("x")).groupBy(F.col("x.terms").alias("term")).agg(F.sum((F.col("x.b") - F.col("x.a")).cast("bigint")).alias("df"))


def index(shards: DataFrame, documents: int, length: int) -> DataFrame:
    """The trees (INDEX) of shards of ``postings``, impacts by the number of documents with a term and of all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                ids, starts = r["ids"].as_py(), np.array(r["starts"].as_py())
                at, tf = (np.frombuffer(r[c].as_py(), "<i4").astype(np.int64) for c in ("at", "tf"))
                n = np.array(r["lengths"].as_py(), np.int64)
                m = 100 - 90 + (90 * n * documents) // max(length, 1)
                impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[at])
                term = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                order = np.lexsort((at, -impact, term))
                bits = DualSorted.bits(at[order], len(ids))
                yield pa.RecordBatch.from_pylist([{"docs": r["docs"].as_py(), "length": r["length"].as_py(), "ids": ids, "terms": r["terms"].as_py(), "starts": starts.tolist(), "tree": np.packbits(bits, axis=1).tobytes(), "impacts": impact[order].astype("<i4").tobytes()}], schema)

    schema = pa.schema([("docs", pa.int64()), ("length", pa.int64()), ("ids", pa.list_(pa.int64())), ("terms", pa.list_(pa.string())), ("starts", pa.list_(pa.int32())), ("tree", pa.binary()), ("impacts", pa.binary())])
    return arrow_map(shards, run, INDEX)


def load(tree: bytes, impacts: bytes, size: int) -> DualSorted:
    """The tree of a row of ``index`` over ``size`` documents."""
    impact = np.frombuffer(impacts, "<i4")
    levels = max(1, int(size - 1).bit_length())
    packed = np.frombuffer(tree, np.uint8).reshape(levels, -1)
    return DualSorted(np.unpackbits(packed, axis=1, count=len(impact)).astype(bool), impact, size)


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term) of ``items`` (item_id, text), each term once; ``item`` numbers the rows."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.array_distinct(F.split(lower, PARTS)).alias("terms"))
    return rows.select("item", "item_id", F.explode("terms").alias("term")).filter("term <> ''")


def find(trees: DataFrame, asked: DataFrame, k: int = 10, every: bool = False) -> DataFrame:
    """(item, item_id, rank, doc_id, score): each item's k documents of the highest score above 0, ties by smaller ids, then
    null ids. ``trees``: a written table of INDEX; ``asked``: a written table (item, item_id, term, w).

    Items go to every shard in blocks of BROADCAST_BYTES; a task carries each item's k best from shard to shard, as a floor
    below which no node is opened, and gives them at its end, so that k rows an item and task meet in the last ranking.
    """
    spark = trees.sparkSession
    size = asked.agg(F.sum(F.octet_length("term") + 40)).first()[0] or 0
    blocks = -(-size // BROADCAST_BYTES)
    found = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).collect()  # a block's rows only
        items: dict[int, tuple] = {}
        for r in rows:
            items.setdefault(r.item, (r.item_id, [], []))
            items[r.item][1].append(r.term)
            items[r.item][2].append(r.w)
        held = spark.sparkContext.broadcast(items)
        out = arrow_map(trees.select("ids", "terms", "starts", "tree", "impacts"), _searcher(held, k, every), "item bigint, item_id bigint, doc_id bigint, score bigint")
        found = out if found is None else found.unionByName(out)
    if found is None:
        return spark.createDataFrame([], "item bigint, item_id bigint, rank int, doc_id bigint, score bigint")
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("item", "item_id", "rank", "doc_id", "score")


def _searcher(held, k: int, every: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, best = held.value, {}
        for b in batches:
            for i in range(b.num_rows):
                place = {t: j for j, t in enumerate(b.column("terms")[i].as_py())}
                starts = np.array(b.column("starts")[i].as_py())
                ids = b.column("ids")[i].values.fill_null(LAST).to_numpy()
                tree = load(b.column("tree")[i].as_py(), b.column("impacts")[i].as_py(), len(ids))
                for item, (_, terms, weights) in items.items():
                    at = [(place[t], w) for t, w in zip(terms, weights, strict=True) if t in place]
                    if at and not (every and len(at) < len(terms)):
                        term, w = np.array(at, np.int64).T
                        best[item] = tree.top(starts[term], starts[term + 1], w, k, ids, best.get(item, []), every)
        rows = [(q, items[q][0], None if d == -LAST else -d, s) for q, found in best.items() for s, d in found]
        names = ("item", "item_id", "doc_id", "score")
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(4)], list(names))

    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 10, every: bool = False) -> DataFrame:
    """(item_id, rank, doc_id, score): ``find`` for ``items`` (item_id, text) over an index of ``docs`` (doc_id, text).

    The index holds the items' terms alone while these are few, else all terms, which changes no result. A weight is
    floor(1000 * ln((2N + 2) / (2 df + 1))), N and df over all shards. Null or wordless items and tables without terms find
    nothing; repeated items are ranked each; very long texts are shards of their own; other columns are left out.
    """
    asked = materialize(item_terms(items), "lexical-items")
    names = asked.select("term").distinct()
    few = [r.term for r in names.collect()] if is_small(asked) else None
    shards = materialize(postings(docs, few), "lexical-postings")
    documents, length = shards.agg(F.sum("docs"), F.sum("length")).first()
    # a term that no document holds adds nothing, but none has all terms of its items
    counted = asked.join(document_counts(shards), "term", "left" if every else "inner")
    weight = F.floor(1000 * F.log((2.0 * F.lit(documents or 0) + 2) / (2 * F.coalesce("df", F.lit(0)) + 1)))
    asked = materialize(counted.select("item", "item_id", "term", weight.alias("w")), "lexical-weights")
    trees = materialize(index(shards, documents or 0, length or 0), "lexical-index")
    return find(trees, asked, k, every).drop("item")
