"""The registered queries of these operators, each over its whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyflow.llm.ann import nearest
from tallyflow.llm.bpe import encode_digests
from tallyflow.llm.centroids import cluster, cluster_sql
from tallyflow.llm.collocations import COLLOCATION_SQL, collocations
from tallyflow.llm.exact_dedup import exact_classes
from tallyflow.llm.langid import identify
from tallyflow.llm.lm_score import scores
from tallyflow.llm.packing import pack
from tallyflow.llm.sharding import shard_rows
from tallyflow.llm.simhash import near_duplicates
from tallyflow.llm.token_count import token_counts
from tallyflow.llm.toxicity import toxicity
from tallyflow.llm.warc import archive_pages

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"))


LLM_QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_lm_score": op4_lm_score,
    "op5_warc": op5_warc,
    "op6_ann": op6_ann,
    "op7_toxicity": op7_toxicity,
    "op8_simhash": op8_simhash,
    "op9_language": op9_language,
    "op10_bpe": op10_bpe,
    "op11_token_counts": op11_token_counts,
    "op12_collocations": op12_collocations,
    "op13_centroids": op13_centroids,
}

LLM_ORACLE: dict[str, str] = {
    "op1_exact_dedup": """
        SELECT doc_id,
               max(doc_id) OVER same AS keep_id,
               count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op5_warc": """
        WITH records AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), kept AS (
            SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
                   CASE WHEN strlen(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload)
                        ELSE page_id END AS keep
            FROM records
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN keep <> page_id THEN keep END AS refers_to
        FROM kept
    """,
    "op12_collocations": COLLOCATION_SQL,
    "op13_centroids": cluster_sql(),
}
