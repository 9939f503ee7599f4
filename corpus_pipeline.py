"""From raw documents to encoded training documents, a stage at a time.

Each stage reads all that the stage before kept and is written before the next begins, so a lost
executor costs at most the stage at hand. ``ORACLE_SQL`` is None: SQL expresses neither the trained
classifier nor SimHash groups nor the tokenizer. ``tests/llm/test_pipeline.py`` holds each stage
against a plain version instead: the same score a text at a time, sets, all pairs, SQL, the original
library.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from korridor.llm.common import cut, table
from korridor.llm.exact_dedup import exact_dedup
from korridor.llm.mixing import mixed
from korridor.llm.queries import PIECES
from korridor.llm.sentencepiece_backend import encode_documents
from korridor.llm.simhash import near_dedup
from korridor.llm.token_files import tokenizer_path
from korridor.llm.toxicity import keep_clean


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic."""
    return keep_clean(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the largest doc_id of each group of equal texts."""
    return exact_dedup(docs)


def unlike(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each group of near duplicates (equal ids: the first stored)."""
    return near_dedup(docs)


def weighed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes the block in which it begins."""
    return mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each row's text, counted and digested, and whether decoding them gives the text back."""
    return encode_documents(docs, tokenizer_path(PIECES))


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("simhash near-dedup", unlike), ("mixing", weighed), ("sentencepiece", encoded)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
