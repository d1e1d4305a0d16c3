"""From raw documents to token ids in stages, each written as Parquet and read again as the documents of the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidyveil.llm import bpe, decontaminate, exact, simhash, toxicity
from tidyveil.llm.common import stored

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model of the labels, but for those held out, takes as toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train_model(docs, labels.filter(~toxicity.held_out()))
    return toxicity.without_toxic(docs, model)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays."""
    return exact.drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group linked by fingerprints of three-word shingles, three bits apart at most, the smallest doc_id stays."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item, or all of a shorter one, go."""
    return decontaminate.without_passages(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every remaining document, with the digest of the bytes they decode to."""
    keep = ["doc_id", "lang", "source"]
    encoded = bpe.encode(docs, RANKS, PATTERN, keep)
    back = bpe.decode(encoded.withColumn("ids", F.col("tokens")), RANKS, PATTERN, [*keep, "ids"])
    return back.select(*keep, F.size("ids").cast("long").alias("n_tokens"), F.col("ids").alias("tokens"), F.sha2("bytes", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("simhash_near_dedup", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("byte_bpe", tokenized),
]

#: The toxicity model and the search for near copies have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
