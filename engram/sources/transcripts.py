"""Transcripts: JSON-lines rows to user messages, and numbered prompts of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of user rows whose content is a text or a list of text blocks; unreadable lines are skipped."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.try_parse_json("value").alias("v"))
    role = F.coalesce(F.try_variant_get("v", "$.role", "string"), F.try_variant_get("v", "$.message.role", "string"), F.try_variant_get("v", "$.type", "string"))
    content = F.coalesce(F.try_variant_get("v", "$.content", "variant"), F.try_variant_get("v", "$.message.content", "variant"))
    rows = lines.filter(role.isin("user", "human")).withColumn("c", content)
    blocks = F.try_variant_get("c", "$", "array<struct<type: string, text: string>>")
    texts = F.transform(F.filter(blocks, lambda b: b.type == "text"), lambda b: b.text)
    whole = F.when(F.schema_of_variant("c") == "STRING", F.variant_get("c", "$", "string")).otherwise(F.array_join(texts, "\n"))
    return rows.select("file", whole.alias("text")).filter("text <> ''")


def prompts(messages: DataFrame, most: int = 100) -> DataFrame:
    """(conv_id, n, prompt): a conversation's first user messages, numbered, a line each."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.filter("role = 'user'").withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= most)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("rn", "text"))), lambda x: F.concat(x.rn.cast("string"), F.lit(". "), x.text))
    return rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(lines, "\n").alias("prompt"))
