"""Relevance and decay: scores of memories, stale lists, pruning, digests, compression, junk and evidence gates."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from engram.functions import text as tx

#: Fixed values of the relevance score.
STABILITY_DAYS = {"decision": 180, "error": 90, "task": 30, "fact": 30, "observation": 3, "progress": 7, "note": 14, "knowledge_entry": 60}
PRIORITY = {"high": 1.5, "normal": 1.0, "low": 0.5}
CATEGORY = {"decision": 1.3, "error": 1.2, "task": 1.0, "warning": 1.0, "fact": 0.9, "observation": 0.8, "progress": 0.8, "note": 0.7}
DECAY, FACTOR, DEFAULT_STABILITY, UNKNOWN_CATEGORY = -0.5, 19 / 81, 30, 0.7
EVIDENCE = {"decision": ["rationale"], "error": ["source"], "fact": ["source"], "knowledge_entry": ["source"]}


def lookup(values: dict, key: Column, default: float) -> Column:
    table = F.create_map(*(F.lit(x) for x in chain(*((k, float(v)) for k, v in values.items()))))
    return F.coalesce(F.try_element_at(table, key), F.lit(float(default)))


def relevance(priority: Column, category: Column, accesses: Column, days: Column) -> Column:
    """Weights times access boost times power-law retention times a recency boost that fades over a week."""
    weight = lookup(PRIORITY, priority, 1.0) * lookup(CATEGORY, category, UNKNOWN_CATEGORY)
    boost = F.when(accesses > 0, F.least(1 + F.log2(accesses.cast("double")) * 0.1, F.lit(2.0))).otherwise(1.0)
    return weight * boost * retention(category, accesses, days)


def retention(category: Column, accesses: Column, days: Column) -> Column:
    """Of a memory last read ``days`` ago; one never read hasn't decayed."""
    stability = lookup(STABILITY_DAYS, category, DEFAULT_STABILITY)
    days = F.greatest(F.coalesce(days, F.lit(0.0)), F.lit(0.0))
    kept = F.pow(1 + F.lit(FACTOR) * days / stability, F.lit(DECAY))
    return kept * (1 + 0.3 * F.log(1.0 + accesses) * F.exp(-days * 24 / 168))


def initial(priority: Column, category: Column) -> Column:
    return F.least(lookup(PRIORITY, priority, 1.0) * lookup(CATEGORY, category, UNKNOWN_CATEGORY), F.lit(2.0))


def temporal_boost(score: Column, age_days: Column) -> Column:
    return score * (1 + 0.3 * F.exp(-age_days / 30))


def blended(score: Column, relevance: Column) -> Column:
    return 0.7 * score + 0.3 * F.coalesce(relevance, F.lit(1.0))


def relevance_stats(scored: DataFrame, score: str = "score") -> DataFrame:
    s = F.col(score)
    return scored.agg(
        F.count("*").alias("total"),
        F.round(F.avg(s), 6).alias("average"),
        F.count_if(s < 0.3).alias("stale"),
        F.count_if((s >= 0.3) & (s < 0.4)).alias("low"),
        F.count_if((s >= 0.4) & (s < 0.7)).alias("medium"),
        F.count_if(s >= 0.7).alias("high"),
    )


def stale(scored: DataFrame, below: float = 0.3, days: float | None = None, limit: int = 1000) -> DataFrame:
    """Lowest scores first; with ``days`` only what wasn't read for so long, or never."""
    rows = scored.filter(F.col("score") < below)
    if days is not None:
        rows = rows.filter(F.col("days").isNull() | (F.col("days") >= days))
    return rows.orderBy("score", "memory_id").limit(limit)


def prunable(scored: DataFrame, below: float = 0.2, days: float = 30, limit: int = 500) -> DataFrame:
    return scored.filter((F.col("score") < below) & (F.col("accesses") == 0) & (F.col("days") > days)).orderBy("memory_id").limit(limit)


def digests(memories: DataFrame, group: list[str], order: str, per: int = 20, cut: int = 200, longest: int = 2000) -> DataFrame:
    """Groups in runs of ``per``: facts of ``key: value`` a line each, cut with an ellipsis beyond ``longest``."""
    w = Window.partitionBy(*group).orderBy(order)
    rows = memories.withColumn("part", F.floor((F.row_number().over(w) - 1) / per).cast("int"))
    fact = F.substring(F.concat(F.col("key"), F.lit(": "), F.col("value")), 1, cut)
    joined = rows.groupBy(*group, "part").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, fact.alias("f")))), lambda x: x.f), "\n").alias("t"))
    text = F.when(F.length("t") > longest, F.concat(F.substring("t", 1, longest - 3), F.lit("..."))).otherwise(F.col("t"))
    return joined.select(*group, "part", "n", text.alias("digest"))


def compress(memories: DataFrame, group: str, order: str = "memory_id") -> DataFrame:
    """(group, facts, sources, ratio): values that are equal but for case and white space count once, the first."""
    norm = F.lower(tx.collapse(F.col("value")))
    first = memories.groupBy(group, norm.alias("norm")).agg(F.min(order).alias("first"), F.count("*").alias("n"))
    return first.groupBy(group).agg(F.count("*").alias("facts"), F.sum("n").alias("sources")).withColumn("ratio", F.round(F.col("facts") / F.col("sources"), 6))


def facts(memories: DataFrame, group: str, order: str = "memory_id") -> DataFrame:
    """(group, order, fact, sources): the facts that ``compress`` counts, each as its first memory wrote it but for white
    space at its ends, with the number of memories that say it."""
    norm = F.lower(tx.collapse(F.col("value")))
    first = memories.groupBy(group, norm.alias("norm")).agg(F.min_by(F.struct(order, F.trim("value").alias("fact")), order).alias("r"), F.count("*").alias("sources"))
    return first.select(group, "r.*", "sources")


def junk_reason(value: Column) -> Column:
    """The first rule that a value breaks, or null: empty, short, filler, bare URL, one character or one word > 60 %."""
    t = F.trim(value)
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    words = F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != "")

    def most(items: Column) -> Column:
        # runs of the sorted items; the longest run is the largest count
        run = F.struct(F.lit(None).cast("string").alias("last"), F.lit(0).alias("n"), F.lit(0).alias("best"))

        def step(acc: Column, x: Column) -> Column:
            n = F.when(acc.last == x, acc.n + 1).otherwise(1)
            return F.struct(x.alias("last"), n.alias("n"), F.greatest(acc.best, n).alias("best"))

        return F.aggregate(F.array_sort(items), run, step, lambda acc: acc.best)

    repeated = (most(chars) / F.length(t) > 0.6) | ((F.size(words) >= 3) & (most(words) / F.size(words) > 0.6))
    return (
        F.when(t == "", "empty content")
        .when(F.length(t) < 10, "too short (< 10 chars)")
        .when(F.lower(t).isin(tx.FILLERS), "generic filler")
        .when(t.rlike(r"(?i)^https?://\S+$"), "bare URL without context")
        .when(repeated, "repetitive content")
    )


def missing_evidence(category: Column, present: Column) -> Column:
    """Required metadata fields of the category that the array ``present`` lacks."""
    table = F.create_map(*chain(*((F.lit(k), F.array(*map(F.lit, v))) for k, v in EVIDENCE.items())))
    none = F.array().cast("array<string>")
    return F.array_except(F.coalesce(F.try_element_at(table, category), none), F.coalesce(present, none))


def evidence_verdict(category: Column, present: Column, bypass: Column | None = None, block: tuple[str, ...] = ()) -> Column:
    """struct(passed, warning): a gate with missing fields warns, for the categories in ``block`` it fails; ``bypass`` (an
    admin) skips it, and so does a category without a gate. The warning is null where there is none."""
    missing = missing_evidence(category, present)
    open_ = (F.size(missing) == 0) | (F.coalesce(bypass, F.lit(False)) if bypass is not None else F.lit(False))
    text = F.concat(F.lit('Evidence gate for "'), category, F.lit('": missing required metadata fields: '), F.array_join(missing, ", "))
    return F.struct((open_ | ~F.coalesce(category.isin(*block), F.lit(False))).alias("passed"), F.when(~open_, text).alias("warning"))


def wants_extraction(category: Column, size: Column, explicit: Column) -> Column:
    return F.coalesce(explicit, F.lit(False)) | F.coalesce(category.isin("decision", "error", "fact", "knowledge_entry"), F.lit(False)) | (size > 500)


def access_counts(reads: DataFrame, now_ms: int) -> DataFrame:
    """(memory_id, accesses, days): batch form of tracking; days since the last read."""
    return reads.groupBy("memory_id").agg(F.count("*").alias("accesses"), ((F.lit(now_ms) - F.max("ms")) / 86_400_000).alias("days"))
