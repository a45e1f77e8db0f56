"""Keys that hold a large part of all rows: null and repeated ids, hosts, sources."""

import hashlib
import random

from pyspark.sql import functions as F

from engram.llm import common, fingerprint, packing, queries, urlrep


def test_fingerprints_of_null_and_repeated_ids(spark):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choices(["ab", "cde", "fgh", "ijkl", "é"], k=rng.randint(0, 30)))
    rows = [(None, text()) for _ in range(300)] + [(7, text()) for _ in range(300)] + [(i, text()) for i in range(200)] + [(None, None), (7, None), (7, "same"), (7, "same")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    order = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    order = [(r.doc_id, r.text) for r in order.orderBy(F.desc_nulls_last("doc_id"), F.desc("hash"), F.desc("text")).collect()]
    want = []
    for i, (k, t) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        edit = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        want.append((str(k), len(t), hashlib.sha256(edit.encode()).hexdigest()))
    got = fingerprint.edited_fingerprints(docs)
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got.collect()) == sorted(want)


def test_half_of_the_ids_are_null_or_one(spark):
    for key in (None, 5):
        docs = spark.range(4000).select(F.when(F.col("id") % 2 == 0, F.lit(key).cast("bigint")).otherwise(F.col("id")).alias("id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
        sizes = sorted(r["count"] for r in fingerprint.chain(docs).groupBy(F.spark_partition_id()).count().collect())
        assert sum(sizes) >= 4000 and sizes[-1] <= 4 * sizes[len(sizes) // 2]


def test_one_host_has_most_pages(spark, monkeypatch):
    """Verdicts are those of a plain join, whether hosts are broadcast or only the hot one is."""
    urls = ["http://hot.com/a"] * 60 + [f"http://h{i}.org/en/{i}" for i in range(30)] + [None] * 20 + ["no scheme"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("_rows", F.lit(1))
    outcomes = spark.createDataFrame([("hot.com", 1)] * 40 + [("h1.org", 0)] * 9, "host string, good int")
    seen = []
    for limit, hot in ((1 << 24, 100_000), (0, 25), (0, 100_000)):
        monkeypatch.setattr(common, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(common, "HOT", hot)
        seen.append(sorted((r.page_id, r.host, r.path, r.rule, r.verdict, round(r.bound, 9)) for r in urlrep.judge_urls(pages, outcomes).fillna({"rule": ""}).collect()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) == len(urls)
    assert {r[4] for r in seen[0] if r[1] == "hot.com"} == {"allow"}


def test_target_of_the_null_source(spark):
    text = "one plain sentence of some words that is said again " * 400
    docs = spark.createDataFrame([(i, text, s) for i, s in enumerate((None, "a", "\0", "") * 6)], "doc_id bigint, text string, source string")
    got = packing.pack(docs, queries.tokenizer_path("word_bpe_49k.json"), {None: 3.0, "a": 1.0}).collect()
    assert {r.source for r in got} == {None, "a", "\0", ""}
    first = {s: sum(r.length for r in got if r.sequence_id == 0 and r.source == s) for s in (None, "a", "\0", "")}
    assert abs(first[None] - 3072) <= 2 and abs(first["a"] - 1024) <= 2  # a round's rounding
    size = {r.doc_id: r.doc_tokens for r in got}
    assert sum(r.length for r in got) == sum(size.values()) and len(size) == 24
