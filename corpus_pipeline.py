"""A corpus pipeline: toxic documents go, one document of each similarity component stays, personal data gets
pseudonyms, and the rest is packed into windows. Each stage takes (spark, docs, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.llm import jaccard, packing, pii, toxicity
from caseloom.llm.common import saved
from caseloom.llm.queries import grades, pii_key, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the severity limit; the model is fitted on the stage's own labelled documents."""
    return toxicity.kept(docs, toxicity.fit(docs, grades(spark, sf_dir)))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, the one with the smallest id; of repeated rows one stays, and documents without an
    id count as others do."""
    return jaccard.one_of_each(docs).select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets replaced; n_chars follows the text."""
    return pii.pseudonymised(docs, pii_key(), spans_col=None).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), "n_chars")).select(*docs.columns)


def windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("near_duplicates", keep_one), ("pii", pseudonyms), ("packing", windows)]
#: Tokenizer ids and trained weights are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
