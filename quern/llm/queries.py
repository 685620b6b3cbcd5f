"""The registered queries of this subpackage: each operator over its whole table, and SQL for it."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quern.llm import bpe, chat, decontaminate, prefix_trie, secret_scan, sentence_pieces, simhash, spelling, substring_dedup, token_counts, topk, toxicity, url_filters
from quern.llm._spark import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoding_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    record = json.dumps({"messages": [{"role": "user", "content": probe}, {"role": "assistant", "content": probe}]})
    extra = chat.canonical_turns(spark.createDataFrame([(-7, record)], "id long, record string"))
    turns = chat.table_turns(table(spark, sf_dir, "conversations"))
    return chat.formatted_digests(turns.union(extra.select("id", "turn", "role", "text")))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.piece_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_counts, op2_url_filters, op3_bpe, op4_simhash, op5_topk, op6_decontamination, op7_secrets, op8_toxicity, op9_substring_dedup, op10_chat_format, op11_sentence_pieces, op12_spelling, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": url_filters.sql(), "op5_topk": topk.sql(), "op6_decontamination": decontaminate.sql(), "op9_substring_dedup": substring_dedup.sql(), "op10_chat_format": chat.sql(), "op12_spelling": spelling.sql(), "op13_prefix_trie": prefix_trie.sql()}
