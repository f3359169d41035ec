"""A corpus pipeline: toxic documents go, one document of each near-duplicate class stays, documents with benchmark
passages go, and what is left is encoded. Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the next stage's docs; all but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontaminate, minhash, sentencepiece_codec, toxicity
from palimpsest.llm.common import Scratch, read_table, small_batches
from palimpsest.llm.queries import piece_model


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold. Null and empty texts stay, repeated rows stay or go together."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(small_batches(spark), sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates, of repeated rows and ids too. Null and empty texts all stay."""
    small_batches(spark)
    return minhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item to the threshold. Null and empty texts stay."""
    return decontaminate.clean_documents(docs, read_table(small_batches(spark), sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of every row's pieces; null and empty texts have none, null ids stay null."""
    small_batches(spark)
    return sentencepiece_codec.encode_documents(docs, piece_model())


STAGES = [("toxicity", drop_toxic), ("minhash_near_dedup", drop_near_duplicates), ("benchmark_decontamination", drop_contaminated), ("sentencepiece", encode)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents. A stage's table goes once the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        before, docs = docs, scratch.cut(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return docs
