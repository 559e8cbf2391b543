"""The corpus pipeline against its stages by hand, on odd rows and on an empty table."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyflow.llm.exact_dedup import exact_classes
from tallyflow.llm.langid import identify
from tallyflow.llm.packing import pieces
from tallyflow.llm.simhash import near_duplicates
from tallyflow.llm.toxicity import toxicity

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def written(folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return folder


def cells(rows):
    return sorted((tuple(r) for r in rows), key=str)


def test_pipeline_equals_its_stages_by_hand(spark, sample):
    """Each stage keeps what its operator's own decisions on its input say, and the run gives the last one's rows."""
    folder = "/root/testdata/sf0.001"
    docs = sample("documents")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language_id", "exact_dedup", "simhash_near_dedup", "packing"]
    decisions = {
        "toxicity": lambda d: toxicity(d, sample("labels")).filter("predicted = 0").select("doc_id"),
        "language_id": lambda d: identify(d).filter("lang_pred <> 'und'").select("doc_id"),
        "exact_dedup": lambda d: exact_classes(d).filter("kept").select("doc_id"),
        "simhash_near_dedup": lambda d: near_duplicates(d).groupBy("component_id").agg(F.min("doc_id").alias("doc_id")).select("doc_id"),
    }
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns
        own, ids = cells(kept.collect()), {r.doc_id for r in kept.select("doc_id").collect()}
        chosen = {r.doc_id for r in decisions[name](docs).collect()}
        if name == "language_id":
            assert ids <= chosen and len(ids) >= 0.99 * len(chosen)
        else:
            assert ids == chosen
        assert own == cells(docs.filter(F.col("doc_id").isin(list(ids))).collect())
        docs = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert cells(corpus_pipeline.run(spark, folder).collect()) == cells(packed.collect())
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert cells(packed.select(columns).collect()) == cells(pieces(docs).select(columns).collect())


def test_pipeline_of_odd_rows(spark, odd_docs, folder):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int")
    found = corpus_pipeline.run(spark, written(folder, odd_docs, labels))
    texts = {(r.doc_id, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd_docs.collect() if any(map(str.isalpha, r.text or ""))}
    assert {r.doc_id for r in found.collect()} <= {i for i, _ in texts}
    parts = found.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("whole"), F.count_if(F.col("start") == 0).alias("texts"))
    assert all(r.n == r.whole * r.texts for r in parts.collect())


@pytest.mark.parametrize("labelled", [True, False])
def test_pipeline_of_nothing(spark, folder, labelled):
    labels = spark.createDataFrame([(1, 1, 0)] if labelled else [], "doc_id long, quality int, toxic int")
    found = corpus_pipeline.run(spark, written(folder, spark.createDataFrame([], DOCUMENTS), labels))
    assert found.collect() == [] and "sequence_id" in found.columns
