"""Vectors: exact cosine search, thresholds, filters, dimension checks, hashing vectoriser."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.session import broadcast_if_small, materialize, ship

#: Words whose hashes a task keeps; bytes of a text, and entries of vectors, that it works on at a time.
KEPT, PIECE = 1 << 18, 1 << 20
_WORD, _NO_WORD = re.compile(rb"[0-9A-Za-z_]+"), re.compile(rb"[^0-9A-Za-z_]")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if a side is a zero vector."""
    return F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))


def search(vectors: DataFrame, query: list[float], limit: int = 10, threshold: float | None = None, where: Column | None = None, id_col: str = "vec_id") -> DataFrame:
    """(id, score): filters first, then exact similarity, then the top rows."""
    if where is not None:
        vectors = vectors.filter(where)
    q = F.array(*(F.lit(float(x)) for x in query))
    scored = vectors.select(id_col, cosine(F.col("embedding"), q).alias("score"))
    if threshold is not None:
        scored = scored.filter(F.col("score") >= threshold)
    return scored.orderBy(F.desc("score"), id_col).limit(max(1, min(limit, 1000)))


def checked(vectors: DataFrame, dims: int) -> DataFrame:
    """Fails at run time on a vector of another size."""
    return vectors.filter(F.assert_true(F.size("embedding") == dims, f"a vector must have {dims} dimensions").isNull())


class _Digests(dict):
    """SHA-256 of words, KEPT of them at most."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= KEPT:
            self.clear()
        self[word] = d = sha256(word).digest()
        return d


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, in parts of about PIECE bytes that end between words."""
    at = 0
    while at < len(text):
        beyond = _NO_WORD.search(text, at + PIECE)
        end = beyond.start() if beyond else len(text)
        yield _WORD.findall(text[at:end])
        at = end


def _sums(text: bytes, dims: int, grams: int, digests: _Digests) -> np.ndarray:
    """Signed hashing of a text's grams."""
    out, last = np.zeros(dims), []
    for part in _pieces(text):
        words = last + part
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        starts, ends, joined = (ends - size).tolist(), ends.tolist(), b"_".join(words)
        found = [digests[w] for w in part]
        for n in range(2, grams + 1):
            first = max(len(last), n - 1)  # the word that ends the first new gram
            found += [sha256(joined[i:j]).digest() for i, j in zip(starts[first - n + 1 :], ends[first:])]
        if found:
            h = np.frombuffer(b"".join(found), ">i4")[::8].astype(np.int64)
            out += np.bincount(np.abs(h) % dims, np.where(h >= 0, 1.0, -1.0), dims)
        last = words[len(words) - min(len(words), grams - 1) :]
    return out


def _hashed(dims: int, grams: int, unit: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, idx, weight) of (id, text): a text's grams are hashed and summed in its row, to unit length with ``unit``."""
    digests = _Digests()
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            rows, places, weights, held = [], [], [], 0
            while at < batch.num_rows and held < PIECE:
                text = batch.column(1)[at].as_py()
                s = _sums(text, dims, grams, digests) if text else np.zeros(0)
                (idx,) = np.nonzero(s)
                s = s[idx]
                rows.append(np.full(len(idx), at))
                places.append(idx)
                weights.append(s / np.sqrt((s * s).sum()) if unit else s)
                held += len(idx)
                at += 1
            ids = batch.column(0).take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(places), pa.int64()), pa.array(np.concatenate(weights))], ["id", "idx", "weight"])


def hashed(docs: DataFrame, id_col: str, text_col: str, dims: int = 768, grams: int = 3) -> DataFrame:
    """(id, idx, weight): signed hashing of word 1- to ``grams``-grams, unit length, sparse.

    The first 32 bits of a gram's SHA-256 are a signed number: its absolute value modulo ``dims`` is the place, its sign
    the sign. A text's vector is made in its row; only those of ids with several rows are added up, null being an id.
    """
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.lower(text_col).cast("binary").alias("text"))

    def made(rows: DataFrame, unit: bool) -> DataFrame:
        return rows.mapInArrow(partial(_hashed, dims, grams, unit), f"id {kind}, idx bigint, weight double")

    repeated = materialize(texts.groupBy("id").count().filter("count > 1").select(F.col("id").alias("_many")), "repeated")
    if repeated.isEmpty():
        out = made(texts, True)
    else:
        same = F.col("id").eqNullSafe(F.col("_many"))
        repeated = broadcast_if_small(repeated)
        s = F.col("s")
        added = made(texts.join(repeated, same, "left_semi"), False).groupBy("id", "idx").agg(F.sum("weight").alias("s")).filter("s <> 0")
        added = added.select("id", "idx", (s / F.sqrt(F.sum(s * s).over(Window.partitionBy("id")))).alias("weight"))
        out = made(texts.join(repeated, same, "left_anti"), True).unionByName(added)
    return out.select(F.col("id").alias(id_col), "idx", "weight")


def label_stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("label").agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("dims"))
