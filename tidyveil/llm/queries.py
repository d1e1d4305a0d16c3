"""One query for each operator, over the whole tables it is meant for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidyveil.llm import align, bpe, decontaminate, exact, hard_negatives, pii, pitman_yor, secrets, simhash, toolcalls, toxicity, warc, word_bpe
from tidyveil.llm.registry import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]

#: The rank file and the pattern that goes with it.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@query("op1_secret_scan", secrets.SQL)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets_by_document(table(spark, folder, "documents"))


@query("op2_byte_bpe")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.tokens_by_document(table(spark, folder, "documents"), RANKS, PATTERN)


@query("op3_toxicity")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity_by_document(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_benchmark_decontamination", decontaminate.SQL)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.passages_by_document(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op5_simhash")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.groups_by_document(table(spark, folder, "documents"))


@query("op6_pitman_yor")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return pitman_yor.scores_by_document(table(spark, folder, "documents"))


#: For a reproducible query only. A real key is a secret of the caller's, and gets into no plan that others can read.
KEY = "an example, not a secret"


@query("op7_feistel_pseudonyms")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonyms_by_document(table(spark, folder, "documents"), KEY)


@query("op8_arc_to_warc", warc.SQL)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return warc.records_by_page(table(spark, folder, "pages"))


@query("op10_tool_calls", toolcalls.SQL)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return toolcalls.calls_by_conversation(table(spark, folder, "conversations"))


@query("op9_exact_dedup", exact.SQL)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return exact.copies_by_document(table(spark, folder, "documents"))


#: The file of a tokenizer whose words have ends.
WORDS = public_tokenizers.path("word_bpe_49k.json")


@query("op12_word_bpe")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return word_bpe.tokens_by_document(table(spark, folder, "documents"), WORDS)


#: The files of the two tokenizers that are aligned.
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@query("op13_tokenizer_alignment")
def _(spark: SparkSession, folder: str) -> DataFrame:
    return align.alignment_by_document(table(spark, folder, "documents"), BYTES, PIECES)


@query("op11_hard_negatives", hard_negatives.SQL)
def _(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.negatives_by_anchor(table(spark, folder, "embeddings"))
