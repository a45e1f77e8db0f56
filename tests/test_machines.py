"""State machines in event time: shuffled and late rows over several micro-batches and a restart give the batch's rows."""

import random

import pytest
from pyspark.sql import functions as F

from engram.operators import lifecycle as lc
from engram.operators import state as st
from engram.streaming import machines

KINDS = "user string, event_id bigint, ts timestamp, holder string, severity string, alert string"
MINUTE = 60_000


def made(seed):
    rng = random.Random(seed)
    rows = []
    for i in range(300):
        ms = i * MINUTE // 2 + rng.randrange(5) * 1000
        rows.append((rng.choice("aab"), i, ms, rng.choice("xy"), rng.choice(["warning", "critical", None]), rng.choice("pqr")))
    return rows


def files(spark, folder, rows, parts):
    """One file a micro-batch, rows up to nine minutes out of order."""
    rng = random.Random(1)
    shuffled = sorted(rows, key=lambda r: r[2] + rng.randrange(9) * MINUTE)
    n = -(-len(shuffled) // parts)
    return [shuffled[i : i + n] for i in range(0, len(shuffled), n)]


def write(spark, folder, i, rows):
    df = spark.createDataFrame([(u, e, None if ms is None else ms / 1000, *r) for u, e, ms, *r in rows], KINDS.replace("ts timestamp", "ts double"))
    df.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def drain(spark, folder, name, step, ttl):
    schema = spark.createDataFrame([], KINDS).schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    out = machines.run(source, "user", step, "10 minutes", ttl)
    q = out.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", f"{folder}/{name}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()


STEPS = {
    "spaced": (st.dedup_step(3 * MINUTE), 3 * MINUTE),
    "rate": (st.rate_step(4, 20 * MINUTE), 20 * MINUTE),
    "locks": (st.lock_step(5 * MINUTE), 5 * MINUTE),
    "alerts": (lc.alert_map_step(30 * MINUTE, 2), None),
}


@pytest.mark.parametrize("name", ["rate", "alerts"])
def test_stream_is_batch(spark, tmp_path, name):
    step, ttl = STEPS[name]
    rows = made(4)
    parts = files(spark, tmp_path, rows, 4)
    late = ("a", 9001, 0, "x", "warning", "p")
    for i, p in enumerate(parts[:2]):
        write(spark, tmp_path, i, p)
    drain(spark, tmp_path, name, step, ttl)
    # a restart from the checkpoint; a row far behind the watermark, one without a key, one without a time; the end of time
    for i, p in enumerate([*parts[2:], [late, (None, 9002, 10**9, "x", None, "p"), ("a", 9003, None, "x", None, "p")], [("z", 9999, 10**9, "x", None, "p")], [("z", 10000, 2 * 10**9, "x", None, "p")]]):
        write(spark, tmp_path, 2 + i, p)
    drain(spark, tmp_path, name, step, ttl)
    got = sorted((r.user, r.ms, r.event_id, r.accepted) for r in spark.read.parquet(f"{tmp_path}/{name}").filter("user <> 'z'").collect())
    batch = spark.createDataFrame([(u, e, ms, h, s, a) for u, e, ms, h, s, a in rows], "user string, event_id bigint, ms bigint, holder string, severity string, alert string")
    want = sorted((r.user, r.ms, r.event_id, r.accepted) for r in st.sequential(batch, "user", ["ms", "event_id"], step).collect())
    assert got == want and any(r[3] for r in want) and not all(r[3] for r in want)


def test_alerts_are_cleared_and_evicted():
    step, state, out = lc.alert_map_step(100, 2), None, []
    for ms, alert, severity in ((0, "p", "warning"), (1, "p", "warning"), (2, "p", "critical"), (3, "p", None), (4, "p", "critical"), (5, "q", "warning"), (6, "r", "warning"), (7, "p", "critical"), (8, "q", "warning"), (9, "r", "warning")):
        state, fired = step(state, {"ms": ms, "alert": alert, "severity": severity})
        out.append(fired)
    # p is evicted by r, q by p, r by q
    assert out == [True, False, True, False, True, True, True, True, True, True] and len(state) == 2
