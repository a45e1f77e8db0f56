"""A corpus pipeline: language ID, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. It
works on all that the stage before kept: documents without a language that is found with some certainty go, then those
that the classifier predicts to be bad, then all but one of each group of near-duplicates; the rest is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from engram.llm import langid, neardup, packing, quality
from engram.llm.queries import tokenizer_path
from engram.session import materialize


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts, those without letters and those whose language is unsure go; an empty table stays empty."""
    return langid.keep_identified(docs)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted to be bad go; null and empty texts by the score of an empty one; repeated rows alike."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, also where rows share an id or have none; null and wordless texts all stay."""
    return neardup.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents' tokens; a null text has the end token alone; repeated rows are packed as they stand."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language", identify_language),
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("packing", pack_sequences),
]

#: The stages learn models and build trees, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
