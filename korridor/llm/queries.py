"""The registered queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korridor.llm import exact_dedup, html_text, mixing, sketches
from korridor.llm.alignment import aligned
from korridor.llm.common import cut, drop, shared_dir, table
from korridor.llm.merkle import SQL as MERKLE_SQL
from korridor.llm.merkle import verified_rows
from korridor.llm.minhash import SQL as MINHASH_SQL
from korridor.llm.minhash import minhash_groups
from korridor.llm.sentencepiece_backend import encode_documents
from korridor.llm.simhash import simhash_groups
from korridor.llm.suffix_dedup import suffix_dedup
from korridor.llm.token_counts import TokenRollup, byte_bpe, words
from korridor.llm.token_files import token_files, tokenizer_path
from korridor.llm.toxicity import toxicity

BYTE_BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents")).drop("spans")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents go through every kind of change, each sent twice as after a lost acknowledgement, and end as they are.

    They are loaded; all counts are revised (an end mark more for each document); all documents are
    deleted; all are inserted again with the counts that were loaded.
    """
    rollup = TokenRollup(spark, f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}", {"words-1": words, BYTE_BPE: byte_bpe(tokenizer_path(BYTE_BPE))})
    docs = table(spark, sf_dir, "documents")
    for _ in range(2):
        rollup.apply("load", docs)
    loaded = cut(rollup.current(), "loaded")
    for _ in range(2):
        rollup.apply_counts("recount", loaded.withColumn("tokens", F.col("tokens") + 1))
    for _ in range(2):
        rollup.apply("delete", docs, delete=True)
    for _ in range(2):
        rollup.apply_counts("insert again", loaded)
    rollup.compact()
    drop(loaded)
    return rollup.totals()


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.compare_with_next(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(PIECES))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"), tokenizer_path(BYTE_BPE), tokenizer_path(PIECES))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_rows(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_simhash, op3_token_files, op4_exact_dedup, op5_token_counts, op6_toxicity, op7_html_text, op8_fingerprints, op9_sentencepiece, op10_mixing, op11_minhash, op12_alignment, op13_merkle_manifest)}
SQL: dict[str, str] = {"op4_exact_dedup": exact_dedup.SQL, "op10_mixing": mixing.sql(), "op11_minhash": MINHASH_SQL, "op13_merkle_manifest": MERKLE_SQL}
