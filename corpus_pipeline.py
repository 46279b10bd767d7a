"""Corpus pipeline: five stages from raw documents to shuffled shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again as the next one's docs. All but the last return
the columns of documents. Rows with nulls in any column, empty and very long
texts, repeated rows, empty tables and extra columns pass as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, mixing, ngram_join, quality, sharding
from quarry.llm.tables import table
from quarry.session import materialize

SHARDS = 40
#: Sources get shares in proportion to this power of their rows: 1 keeps the
#: natural shares, 0 makes them equal.
MIX_POWER = 0.5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality classifier rejects (score under 0.3)."""
    model = quality.fit_quality(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates."""
    return ngram_join.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts; drop what is mostly benchmark."""
    return decontaminate.remove_contamination(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every source the share of rows that its weight asks for. All documents
    stay; sources that run out before the last one give blocks of rows again, so
    shares are met to within one block, unless that takes a row more than
    mixing.MOST_REPEATS times. The sharding stage gives rows their order."""
    weights = materialize(mixing.weights_by_size(docs, "source", MIX_POWER), "weights")
    mixed = mixing.mix_sources(docs, weights, refill=True)
    return mixed.select(*[F.col(f"`{c}`") for c in docs.columns])


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffle all documents and place them in shards of equal row counts."""
    sized = docs.withColumn("__size", sharding.record_size(F.col("text")))
    return sharding.shuffle_into_shards(sized, SHARDS, size_col="__size", hash_cols=["doc_id", "text"]).drop("__size")


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: The stages hold trained models and a seeded shuffle, which SQL cannot express;
#: tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
