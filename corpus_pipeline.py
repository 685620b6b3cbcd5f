"""The corpus pipeline: toxicity, near duplicates, benchmark leaks, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and returns the
columns of ``documents``; the last returns digests of the tokens. Further columns of the
input are not carried. Null texts count as empty and stay, as empty texts do.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.llm import bpe, decontaminate, secret_scan, simhash, toxicity
from quern.llm._spark import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: What a secret's characters are replaced by.
REDACTED = "[REDACTED]"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go."""
    judged = toxicity.toxic_filter(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return judged.select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of the smallest id stays. Rows of one id are one document: they stay or go together."""
    docs = docs.select(*COLUMNS)
    groups = simhash.near_copies(docs)
    copies = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.clean_documents(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by ``REDACTED``; the documents stay, with n_chars counted anew."""
    return secret_scan.redacted(docs.select(*COLUMNS), REDACTED).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe.encoding_digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("secret_scans", redact_secrets),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs


#: A trained scorer, fingerprints and merges have no SQL form; the tests compare with plain Python.
ORACLE_SQL = None
