"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from . import (
    attention,
    bpe,
    filter_audit,
    html_extract,
    license_scan,
    mixing,
    prefix_trie,
    quality,
    simhash,
    substring,
    token_counts,
    toxicity,
    winnow,
)
from .common import table, written

#: What a revision takes out of the texts.
SYMBOL_NOISE = r"[#*$%&|<>]+"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnow.compare_edited(table(spark, sf_dir, "documents"), with_text=False)
    return found.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        "near_edited",
        "near_next",
        "match_spans",
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    digits = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return found.select("doc_id", digits.alias("fingerprint"), "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts after three batches, each of them sent twice: all documents come in, their
    texts are revised (symbol noise goes), later copies of equal texts are deleted. Each text
    and its revision are counted once; the batches are made from the stored counts."""
    docs = table(spark, sf_dir, "documents").withColumn("revised", F.regexp_replace("text", SYMBOL_NOISE, ""))
    docs = docs.withColumn("content", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)))
    docs = docs.withColumn("changed", F.expr("coalesce(text <> revised, false)"))
    old = token_counts.document_counts(docs, keep=("doc_id", "source", "lang", "content", "changed", "revised"))
    old = old.withColumnsRenamed({"chars": "old_chars", "counts": "old_counts"})
    both = token_counts.document_counts(
        old, text_col="revised", keep=("doc_id", "source", "lang", "content", "changed", "old_chars", "old_counts")
    )
    both = written(both, "token-counts")
    before = both.withColumns({"chars": F.col("old_chars"), "counts": F.col("old_counts")})
    signed = token_counts.signed
    batches = [
        ("load", signed(before, 1)),
        ("revise", signed(before.where("changed"), -1).unionByName(signed(both.where("changed"), 1))),
        ("dedup", token_counts.later_copies(both)),
    ]
    rollup = token_counts.Rollup(spark, f"{ensure_checkpoint_dir(spark)}/token-ledger-{uuid.uuid4().hex}")
    token_counts.replay(rollup, [b for b in batches for _ in range(2)])
    return rollup.totals()


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mixture(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    found = html_extract.extract(pages, html_extract.train(pages))
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_documents(docs, model)


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = bpe.encode(table(spark, sf_dir, "documents"), TOKENIZER, decoded=True)
    return decoded.select(
        "doc_id",
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is stored once; the policies read its bits back."""
    stored = written(quality.ledger(table(spark, sf_dir, "documents")), "quality-ledger")
    judged = quality.apply_policy(stored, quality.PROSE)
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        (~quality.passes(quality.BASE)).alias("base_failed"),
        "kept",
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    masks = filter_audit.failure_masks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return filter_audit.audit(masks)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = attention.train(docs, table(spark, sf_dir, "labels"))
    return attention.score_documents(docs, model)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_substring_dedup,
        op2_fingerprints,
        op3_simhash,
        op4_token_counts,
        op5_mixing,
        op6_license_scan,
        op7_html_extract,
        op8_toxicity,
        op9_bpe,
        op10_quality_rules,
        op11_filter_audit,
        op12_prefix_trie,
        op13_quality_classifier,
    )
}
