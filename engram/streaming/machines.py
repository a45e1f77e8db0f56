"""State machines over a stream in event time: rows wait until the watermark has passed them, then go through in order.

A key's state is what its step keeps and the rows that still wait, so shuffled and late input give what the batch form
(``operators.state.sequential``) gives on the same rows in order of time. A timer stands for a key's first waiting row; when
nothing waits, the next one stands for the time at which the state says nothing any more, and clears it.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructType

from engram.session import ship

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Machine(StatefulProcessor):
    """Rows of a key by (ms, event_id) through ``step`` (state, row dict) -> (state, output)."""

    def __init__(self, step: Callable, columns: list[str], waiting: str, ttl_ms: int | None):
        self.step, self.columns, self.waiting, self.ttl_ms = step, columns, waiting, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rows = handle.getMapState("rows", "ms bigint, event_id bigint", self.waiting)
        self.state = handle.getValueState("state", "step binary, timer bigint, last bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        least = None
        for part in rows:
            part = part[part["ms"] >= passed]  # the others are late
            for ms, event_id, *row in part[["ms", "event_id", *self.columns]].itertuples(index=False, name=None):
                self.rows.updateValue((int(ms), int(event_id)), tuple(_plain(x) for x in row) or (None,))
                least = ms if least is None else min(least, ms)
        if least is not None:
            blob, timer, last = self.state.get() if self.state.exists() else (None, None, None)
            if timer is None or least + 1 < timer:
                self._wait(timer, int(least) + 1)
                timer = int(least) + 1
            self.state.update((blob, timer, last))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        if not self.state.exists():
            return
        blob, timer, last = self.state.get()
        state = pickle.loads(bytes(blob)) if blob is not None else None
        ready, least = [], None
        for at, row in self.rows.iterator():
            if at[0] < passed:
                ready.append((tuple(at), tuple(row)))
            else:
                least = at[0] if least is None else min(least, at[0])
        out = []
        for (ms, event_id), row in sorted(ready, key=lambda r: r[0]):
            full = {"ms": ms, "event_id": event_id, **dict(zip(self.columns, row, strict=False))}
            state, accepted = self.step(state, full)
            out.append((*key, ms, event_id, *row[: len(self.columns)], bool(accepted)))
            self.rows.removeKey((ms, event_id))
            last = ms
        if least is not None:
            next_timer = int(least) + 1
        elif self.ttl_ms is not None and last + self.ttl_ms >= passed:
            next_timer = int(max(last + self.ttl_ms, passed) + 1)
        else:
            next_timer = None
        if next_timer is None and self.ttl_ms is not None:
            self.state.clear()
        else:
            if next_timer is not None:
                self.handle.registerTimer(next_timer)
            self.state.update((pickle.dumps(state), next_timer, last))
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def _wait(self, old: int | None, new: int) -> None:
        if old is not None:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(new)

    def close(self) -> None:
        pass


def _plain(x):
    """A value of a pandas row as Python has it; missing ones are None."""
    if x is None or x is pd.NaT or (isinstance(x, float) and x != x):
        return None
    return x.item() if hasattr(x, "item") else x


def run(events: DataFrame, key: str, step: Callable, late: str = "10 minutes", ttl_ms: int | None = None) -> DataFrame:
    """(key, ms, event_id, the other columns, accepted) of a stream of events (key, event_id, ts, ...), ids being unique.

    ``step``: those of ``operators.state`` and ``operators.lifecycle``. Rows behind the watermark of ``late`` are dropped; others
    come out as soon as it has passed them. ``ttl_ms``: a state says nothing so long after its last row, and goes. Rows of
    a null key or time are left out; a repeated id takes the first one's place while it waits.
    """
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    rest = [c for c in events.columns if c not in (key, "event_id", "ts", "ms", "accepted")]
    rows = events.filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", late)
    rows = rows.select(key, F.unix_millis("ts").alias("ms"), F.col("event_id").cast("bigint").alias("event_id"), *rest, "ts")
    schema = StructType([f for f in rows.schema.fields if f.name != "ts"]).add("accepted", BooleanType())
    waiting = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name in rest) or "none string"
    machine = Machine(step, rest, waiting, ttl_ms)
    machine.names = schema.names
    return rows.groupBy(key).transformWithStateInPandas(statefulProcessor=machine, outputStructType=schema, outputMode="Append", timeMode="EventTime")
