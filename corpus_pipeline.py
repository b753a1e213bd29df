"""A corpus from raw documents to token ids: quality, exact copies, near copies, source weights, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, minhash_dedup, mixing, quality, sentencepiece_codec
from graphloom.llm.common import drop_rows, fresh_path, settle

SEED = 7


def judge_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.drop_bad(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): the least doc_id. Documents without an id stay."""
    found = minhash_dedup.find_near(docs, words=5, percent=80)
    gone = found.filter("id is not null").groupBy("id").agg(F.max("kept").alias("kept")).filter("not kept").select("id")
    return drop_rows(docs, settle(gone, "near-copies"), "doc_id")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix(docs, weights=(3, 1, 2), share=1.5, most=2.0, seed=SEED)
    return mixing.take_copies(docs, mixed, SEED)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, token_ids, lossless."""
    return sentencepiece_codec.encode(docs, dropout=0.1, seed=5).withColumnRenamed("id", "doc_id")


STAGES = [("quality classifier", judge_quality), ("exact dedup", drop_exact_copies), ("minhash near-dedup", drop_near_copies), ("source mixing", mix_sources), ("sentencepiece encoding", encode_tokens)]

#: SQL can't express n-gram models, densified minima, sampling by keyed hash or merge-dropout; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = fresh_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
