"""Streaming operators, driven to the end over a folder of Parquet."""

from pyspark.sql import functions as F

from engram.streaming import feeds


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def stream(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), e


def test_tumbling_and_sessions(spark, sf, tmp_path):
    s, e = stream(spark, sf, tmp_path)
    got = drain(feeds.tumbling_counts(s, "1 day"), "tumbling").agg(F.sum("n")).first()[0]
    assert 0 < got <= e.count()
    assert drain(feeds.session_counts(s), "sessions").count() > 0


def test_spaced(spark, sf, tmp_path):
    s, e = stream(spark, sf, tmp_path)
    rows = drain(feeds.accept_spaced(s, "user_id", 86_400_000), "spaced").collect()
    last = {}
    for r in sorted(rows, key=lambda r: r.ms):
        assert r.user_id not in last or r.ms - last[r.user_id] >= 86_400_000
        last[r.user_id] = r.ms
    assert len(last) == e.select("user_id").distinct().count()


def test_dedup(spark, sf, tmp_path):
    s, e = stream(spark, sf, tmp_path)
    n = drain(feeds.dedup(s.unionByName(s), ["event_id"]), "dedup").count()
    assert n == e.count()
