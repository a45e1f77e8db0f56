"""Digests of ordered rows, one for each group, of which no task holds the rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engram.session import ship


def ordered_sha256(rows: DataFrame, group: str, line: str, end: str = "", name: str = "digest") -> DataFrame:
    """(group, name): the SHA-256, in lowercase hex, of a group's lines in order, each with ``end`` behind it.

    Groups are ordered by a secondary sort and their lines stream through the hash in Arrow batches, so a group of any size
    takes a hash's state; a group's lines pass one task, as the hash asks. Null lines are left out, a group of nothing else
    has the digest of no text; a null group is a group; an empty table gives an empty one.
    """
    ship(rows.sparkSession)
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ordered = rows.select(F.col(group).alias("g"), F.col(line).alias("l")).repartition(n, "g").sortWithinPartitions("g", F.asc_nulls_last("l"))
    tail = end.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, kind = None, None, None
        for b in batches:
            kind, done = b.schema.field("g").type, []
            groups, lines = b.column("g").to_pylist(), b.column("l").to_pylist()
            start = 0
            while start < len(groups):
                stop = start
                while stop < len(groups) and groups[stop] == groups[start]:
                    stop += 1
                if state is None or groups[start] != current:
                    if state is not None:
                        done.append((current, state.hexdigest()))
                    current, state = groups[start], hashlib.sha256()
                state.update(b"".join(x.encode() + tail for x in lines[start:stop] if x is not None))
                start = stop
            if done:
                yield made(done, kind)
        if state is not None:
            yield made([(current, state.hexdigest())], kind)

    def made(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([g for g, _ in done], kind), pa.array([d for _, d in done], pa.string())], names=["g", name])

    kind = rows.schema[group].dataType.simpleString()
    return ordered.mapInArrow(run, f"g {kind}, {name} string").withColumnRenamed("g", group)


def corpus_hash(files: DataFrame, project: str, path: str = "path", sha256: str = "sha256") -> DataFrame:
    """(project, corpus_hash) over each project's files in order of path: a line of path, tab and content hash each."""
    lines = files.select(project, F.concat(path, F.lit("\t"), sha256).alias("line"))
    return ordered_sha256(lines, project, "line", "\n", "corpus_hash")
