"""Corpus pipeline: quality rules, near-dedup, substring dedup, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns of
``documents``.

Every stage takes nulls in any column, empty and very long texts, ties, repeated rows, further
columns of any name and an empty table: null and empty texts fail the quality rules, so they go
with the first stage; rows without a doc_id form groups of near copies like others, lose words
that any document with an id has too, and are mixed by their text; an empty table stays empty
through all stages.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillroll.llm import bpe, mixing, quality, simhash, substring
from tillroll.llm.queries import TOKENIZER
from tillroll.session import ensure_checkpoint_dir, remove_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the policy rejects go."""
    return quality.keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the smallest doc_id."""
    return simhash.keep_first_of_groups(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that a smaller document has are cut from the text."""
    return substring.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it (0 to 3 times)."""
    return mixing.mixed_documents(docs)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row: doc_id, ids and n_tokens, and the text decoded from the ids."""
    return bpe.encode(docs, TOKENIZER, decoded=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Fingerprints (XXH64), components and the tokenizer are beyond SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read before the next."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:  # nothing reads the stage before any more
            remove_path(spark, f"{folder}/{k - 1}")
    return docs
