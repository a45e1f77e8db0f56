"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from engram.session import ship

#: Text that a Python operator handles at a time; larger Arrow batches are cut into slices of about this size.
SLICE_BYTES = 4 << 20
#: Bytes of rows that are broadcast at most, and rows of one key that a shuffled join may bring to one task.
BROADCAST_BYTES, HOT = 16 << 20, 100_000


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that ``column`` has about ``limit`` bytes in each; a single longer row is a slice of its own."""
    for batch in batches:
        lengths = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = total = 0
        for i, n in enumerate(lengths.tolist()):
            if i > start and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        if batch.num_rows > start:
            yield batch.slice(start)


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package on the executors; a task starts with no other operator's tables in its worker."""
    ship(df.sparkSession)
    own = fn.__module__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter(own)  # by name: what a nested function holds itself reaches the worker as a copy
        try:
            yield from fn(batches)
        finally:
            leave()

    return df.mapInArrow(run, schema)


def is_small(df: DataFrame) -> bool:
    """Whether all rows of ``df``, a written table, have BROADCAST_BYTES at most."""
    width = F.lit(16)
    for f in df.schema.fields:
        wide = f.dataType.simpleString() in ("string", "binary")
        width += F.coalesce(F.octet_length(f.name), F.lit(0)) + 8 if wide else F.lit(8)
    return (df.agg(F.sum(width)).first()[0] or 0) <= BROADCAST_BYTES


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df``, a written table, to be broadcast if it is small, else as it is, to be shuffled."""
    return F.broadcast(df) if is_small(df) else df


def hot_lookup(rows: DataFrame, table: DataFrame, on: str | list[str], count: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``table``, a written one with a row for each key ``on`` and in ``count`` how many rows the key has.

    A small table is broadcast whole. Of others the keys of more than HOT rows are broadcast, as there can't be more than
    one such key for every HOT rows, and the rest are shuffled; so no task gets more than HOT rows of one key. ``count`` is
    dropped. how: inner, left or left_semi; rows with a null key find nothing.
    """
    on = [on] if isinstance(on, str) else on
    named = F.col(on[0]).isNotNull()
    small = table.drop(count)
    if is_small(small):
        return rows.join(F.broadcast(small), on, how)
    hot, cold = F.broadcast(table.filter(F.col(count) > HOT).drop(count)), table.filter(F.col(count) <= HOT).drop(count)
    rest = rows.filter(named).join(hot.select(*on), on, "left_anti")
    out = rows.join(hot, on, "left_semi" if how == "left_semi" else "inner").unionByName(rest.join(cold, on, how))
    return out.unionByName(rows.filter(~named), allowMissingColumns=True) if how == "left" else out


def crc_mod(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id written as text, modulo n: it deals the labelled rows into folds."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def bounded_sample(df: DataFrame, rows: int, *by: str) -> DataFrame:
    """At most ``rows`` rows, those of the smallest hash of ``by``; the same rows whatever the partitioning."""
    return df.orderBy(F.xxhash64(*by), *by).limit(rows)


_KEPT: dict[str, object] = {}


def kept(name: str, make: Callable[[], object] | None = None) -> object:
    """The table ``name`` of this worker, made on first use. A worker keeps the tables of one operator at a time, so those
    of a pipeline's stages don't add up; without ``make`` it keeps none."""
    if name not in _KEPT:
        if _KEPT:
            _KEPT.clear()
            gc.collect()
        if make is None:
            return None
        _KEPT[name] = make()
    return _KEPT[name]


def enter(module: str) -> None:
    """Drop the tables of operators of other modules."""
    if _KEPT and not any(k.startswith(f"{module}:") for k in _KEPT):
        kept("")


def leave() -> None:
    """Give what a task has freed back to the system; workers are used again and would hold it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
