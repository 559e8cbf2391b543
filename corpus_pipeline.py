"""A training corpus from raw documents: each stage reads what its predecessor kept, as a table in the shared folder.

Toxic documents go, then those without a recognised language, exact copies and near copies; what is left
is packed into sequences. Nulls, empty texts, repeated rows and empty tables are defined by the operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm.common import stored
from tallyflow.llm.exact_dedup import exact_dedup
from tallyflow.llm.langid import keep_identified
from tallyflow.llm.packing import pack
from tallyflow.llm.simhash import keep_one
from tallyflow.llm.toxicity import keep_civil

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not predicted toxic by a machine fitted on the labelled ones."""
    return keep_civil(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised."""
    return keep_identified(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 4-word shingles at 4 bits or fewer the one with the smallest id."""
    return keep_one(docs, shingle=4, radius=4)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in sequences of 4096 tokens."""
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("language_id", keep_languages),
    ("exact_dedup", drop_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: Learned classifiers, fingerprints and a tokenizer: SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
