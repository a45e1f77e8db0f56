"""Hooks for what a caller brings: embeddings, rerankers, summaries, compressors, chunkers, extractors of a language model.

A hook is a plain function over batches; it runs as an Arrow map beside the data, distinct texts only, so that a costly one
is called once for each. Without a hook the operators keep their input's order and scores.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ENTITY_FLOOR, RELATION_FLOOR, LINK_FLOOR = 0.7, 0.5, 0.7
#: Entity types that a model may name; others are concepts.
ENTITY_TYPES = ("person", "project", "file", "function", "module", "component", "concept", "decision", "issue", "technology", "pattern")


def map_texts(texts: DataFrame, fn: Callable[[list[str]], Sequence], kind: str, column: str = "text", out: str = "result") -> DataFrame:
    """(text, result) of the distinct texts, null ones left out; ``kind`` is the result's type, ``fn`` maps a list of texts."""
    distinct = texts.select(F.col(column).alias("text")).filter("text is not null").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(fn(b.column("text").to_pylist()))
            if len(made) != b.num_rows:
                raise ValueError("a hook gives one result for each text")
            yield pa.RecordBatch.from_arrays([b.column("text"), pa.array(made, shape)], names=["text", out])

    from pyspark.sql.pandas.types import to_arrow_schema

    shape = to_arrow_schema(distinct.sparkSession.createDataFrame([], f"r {kind}").schema).field(0).type
    return distinct.mapInArrow(run, f"text string, `{out}` {kind}")


def embedded(rows: DataFrame, fn: Callable[[list[str]], Sequence], cache: DataFrame | None = None, column: str = "text") -> tuple[DataFrame, DataFrame]:
    """(rows with ``embedding``, the new cache): texts in the cache (text, embedding) aren't embedded again."""
    todo = rows.select(F.col(column).alias("text")).filter("text is not null").distinct()
    if cache is not None:
        todo = todo.join(cache.select("text"), "text", "left_anti")
    known = map_texts(todo, fn, "array<float>", out="embedding")
    if cache is not None:
        known = cache.select("text", "embedding").unionByName(known)
    return rows.join(known.withColumnRenamed("text", column), column, "left"), known


def hit_rate(rows: DataFrame, cache: DataFrame, column: str = "text") -> DataFrame:
    """(texts, hits, rate): of the rows' texts how many the cache has; 0 without rows."""
    known = rows.select(F.col(column).alias("text")).join(cache.select("text", F.lit(1).alias("hit")).distinct(), "text", "left")
    return known.agg(F.count("*").alias("texts"), F.count("hit").alias("hits"), F.coalesce(F.try_divide(F.count("hit"), F.count("*")), F.lit(0.0)).alias("rate"))


def reranked(hits: DataFrame, query: str, fn: Callable[[str, list[str]], Sequence[float] | None] | None = None, text: str = "text", id_col: str = "doc_id", limit: int = 10) -> DataFrame:
    """(id, score, rank) of a short list by the hook's scores, or, without one or where it gives none, by their own."""
    from engram.operators.search import ranked

    if fn is not None:

        def score(texts: list[str]) -> list[float | None]:
            return list(fn(query, texts) or [None] * len(texts))

        hits = hits.join(map_texts(hits, score, "double", text, "_new").withColumnRenamed("text", text), text, "left")
        hits = hits.withColumn("score", F.coalesce("_new", "score"))
    return ranked(hits.select(id_col, "score").orderBy(F.desc("score"), id_col).limit(limit), id_col)


def looked_up(names: DataFrame, memories: DataFrame, limit: int, similarity: float = 0.5) -> DataFrame:
    """(memory_id, similarity): memories of the entity names (name) that a graph search found, one hop away; ``limit`` * 2."""
    hits = memories.join(names.select("name").distinct(), "name", "left_semi").select("memory_id").distinct()
    return hits.orderBy("memory_id").limit(2 * limit).select("memory_id", F.lit(similarity).alias("similarity"))


def summarised(runs: DataFrame, fn: Callable[[list[str]], Sequence[str]], cache: DataFrame) -> DataFrame:
    """(analysis_id, summary): from the cache (analysis_id, summary), one a run, else by the hook from the run's digest."""
    todo = runs.join(cache.select("analysis_id"), "analysis_id", "left_anti")
    made = map_texts(todo, fn, "string", "digest", "summary").withColumnRenamed("text", "digest")
    return runs.join(cache, "analysis_id").select("analysis_id", "summary").unionByName(todo.join(made, "digest").select("analysis_id", "summary"))


def chunked(files: DataFrame, fn: Callable[[str], list[tuple[int, int, str]]], path: str = "path", text: str = "text") -> DataFrame:
    """(path, start_line, end_line, kind) of the chunks that a chunker gives for each distinct text."""
    kind = "array<struct<start_line: int, end_line: int, kind: string>>"
    made = map_texts(files, lambda ts: [[dict(zip(("start_line", "end_line", "kind"), c, strict=True)) for c in fn(t)] for t in ts], kind, text, "chunks")
    rows = files.select(path, text).join(made.withColumnRenamed("text", text), text)
    return rows.select(path, F.explode("chunks").alias("c")).select(path, "c.*")


def compressed(groups: DataFrame, fn: Callable[[list[str]], Sequence[str]] | None, key: str = "key", text: str = "text", most: int = 20) -> DataFrame:
    """(key, summary): a hook's text for the first ``most`` texts of each key, joined by lines; without one the texts."""
    from engram.operators.temporal import top_per_group

    few = top_per_group(groups.select(key, text), [key], [F.asc(text)], most)
    joined = few.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", text))), lambda r: r[text]), "\n").alias("_t"))
    if fn is None:
        return joined.select(key, F.col("_t").alias("summary"))
    made = map_texts(joined, fn, "string", "_t", "summary").withColumnRenamed("text", "_t")
    return joined.join(made, "_t").select(key, "summary")


# ---- what a language model answers ----------------------------------------------------------------------------------


def model_entities(answers: DataFrame, column: str = "answer") -> DataFrame:
    """(id, name, type, confidence): entities in JSON answers of enough confidence; unknown types are concepts."""
    schema = "entities array<struct<name: string, type: string, confidence: double>>"
    e = answers.select("id", F.explode(F.from_json(column, schema).entities).alias("e")).select("id", "e.*")
    kind = F.when(F.lower("type").isin(*ENTITY_TYPES), F.lower("type")).otherwise("concept")
    return e.filter(F.col("confidence") >= ENTITY_FLOOR).select("id", "name", kind.alias("type"), "confidence")


def model_relations(answers: DataFrame, entities: DataFrame, column: str = "answer", floor: float = RELATION_FLOOR) -> DataFrame:
    """(id, source, target, type, weight, known): relations of enough confidence; known if both ends are entities found."""
    schema = "relations array<struct<source: string, target: string, type: string, confidence: double>>"
    r = answers.select("id", F.explode(F.from_json(column, schema).relations).alias("r")).select("id", "r.*").filter(F.col("confidence") >= floor)
    names = entities.select("id", "name").distinct()
    a, b = (names.select("id", F.col("name").alias(end), F.lit(1).alias(f"_{end}")) for end in ("source", "target"))
    out = r.join(a, ["id", "source"], "left").join(b, ["id", "target"], "left")
    return out.select("id", "source", "target", F.coalesce("type", F.lit("related_to")).alias("type"), F.col("confidence").alias("weight"), (F.col("_source").isNotNull() & F.col("_target").isNotNull()).alias("known"))


def causal_links(answers: DataFrame, column: str = "answer") -> DataFrame:
    """(id, src, dst, confidence): causal links that a model finds with enough confidence."""
    schema = "links array<struct<cause: string, effect: string, confidence: double>>"
    e = answers.select("id", F.explode(F.from_json(column, schema).links).alias("l")).select("id", "l.*")
    return e.filter(F.col("confidence") >= LINK_FLOOR).select("id", F.col("cause").alias("src"), F.col("effect").alias("dst"), "confidence")


def contradictions(candidates: DataFrame, fn: Callable[[list[str]], Sequence[float]], least: float = 0.7, score: float = 0.5, top: int = 3) -> DataFrame:
    """(memory_id, other, confidence): of a memory's best ``top`` candidates (memory_id, other, score, old, new) those
    that the hook finds to contradict it; it sees old and new parted by a line of its own."""
    from engram.operators.temporal import top_per_group

    rows = top_per_group(candidates.filter(F.col("score") >= score), ["memory_id"], [F.desc("score"), F.asc("other")], top)
    rows = rows.withColumn("_t", F.concat_ws("\n---\n", "old", "new"))
    made = map_texts(rows, fn, "double", "_t", "confidence").withColumnRenamed("text", "_t")
    return rows.join(made, "_t").filter(F.col("confidence") >= least).select("memory_id", "other", "confidence")
