"""Registered queries of the training-data operators: each applies one operator
with production parameters to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from public_tokenizers import path as tokenizer_path

from . import bpe, chat, htmlmain, huffman, importance, jaccard, langid, mixing, passages, quality, simhash, topk, vectorcodes
from .common import read_table
from .sql import SQL  # noqa: F401  (re-exported)

TOKENIZER = "byte_bpe_50k.json"
VOCABULARY = "piece_bpe_32k.model"


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.token_files(read_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), with_ids=False)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(read_table(spark, sf_dir, "documents"), tokenizer_path(VOCABULARY))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(read_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.parse(read_table(spark, sf_dir, "conversations"))


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(read_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents")).select("doc_id", *quality.RESULT)


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmlmain.extract(read_table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.vector_codes(read_table(spark, sf_dir, "embeddings"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


REGISTRY = {f.__name__: f for f in (
    op1_token_files, op2_bpe, op3_language, op4_simhash, op5_mixing, op6_chat, op7_passages, op8_quality, op9_topk, op10_main_text,
    op11_vector_codes, op12_importance, op13_jaccard)}
