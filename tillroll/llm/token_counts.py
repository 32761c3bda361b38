"""Delta-maintained token counts by source, language and tokenizer version.

A batch is a frame of signed changes to single documents: an insert adds a document's
counts, a delete takes them away, a revision does both (old counts out, new counts in). A
commit reduces the batch to one signed row per (source, lang, tokenizer), stores it in the
ledger and folds it into the totals, which are kept as a table of their own: reading them
sums no history, and a batch costs what it changes and one small table of totals.

    <path>/batches/<id>/        signed sums of a batch, and the mark _FOLDED
    <path>/totals/v=000007-<id>/  totals up to and with that batch

Commits are idempotent: a batch with the mark is not applied again; only its own folder and
the newest totals are looked at. A commit that breaks off before its totals are complete has
changed nothing that is read and is done anew when it is repeated; one that breaks off after it
lacks the mark only, and the next commit sets it. One writer at a time.

Rows: a null text has 0 tokens; null sources and languages are keys of their own; rows are
counted one by one, so repeated rows count twice. Texts may be of any length and are counted in
steps. Only named columns are read. A batch without rows commits nothing but its id. A key
whose totals have all come back to 0 leaves the totals.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import is_complete, is_marked, list_folders, mark, remove_path
from .common import WORD

KEYS = ("source", "lang", "tokenizer")
SUMS = ("documents", "tokens", "chars")


@dataclass(frozen=True)
class Tokenizer:
    """A version of a tokenizer that cuts by character classes.

    ``classes`` has a class for each byte of UTF-8: 0 is between tokens, equal positive
    classes in a row are one token, and each byte of a negative class is a token (bytes
    that continue a character are 0 where characters stand alone). ``pattern`` says the
    same as a regular expression for engines that count by one.
    """

    name: str
    pattern: str
    classes: tuple[int, ...]


def _classes(letter: int, digit: int, beyond: int, other: int) -> tuple[int, ...]:
    """Classes of ASCII letters and digits, of characters beyond ASCII, and of the other ASCII characters."""
    out = []
    for b in range(256):
        if b == 0x20 or 0x09 <= b <= 0x0D:
            out.append(0)
        elif 0x80 <= b < 0xC0:
            out.append(max(beyond, 0))  # continues a character
        elif b >= 0xC0:
            out.append(beyond)
        else:
            c = chr(b)
            out.append(letter if c.isalpha() else digit if c.isdigit() else other)
    return tuple(out)


#: Versions by name; any other can be passed instead.
TOKENIZERS = {
    t.name: t
    for t in (
        Tokenizer("words-1", WORD, _classes(1, 1, 1, 1)),
        Tokenizer("pieces-1", r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]", _classes(1, 2, -1, -1)),
        Tokenizer(
            "pieces-2",
            r"[A-Za-z\x{80}-\x{10FFFF}]+|[0-9]|[^A-Za-z0-9\x20\x09-\x0D\x{80}-\x{10FFFF}]",
            _classes(1, -1, 1, -1),
        ),
    )
}
SIGNED = T.StructType([T.StructField(k, T.StringType()) for k in KEYS] + [T.StructField(s, T.LongType()) for s in SUMS])
#: Versions of the totals that stay, so that a reader of the one before is not cut off.
KEPT_TOTALS = 3


def count_tokens(raw: bytes, classes: np.ndarray, step: int = 1 << 20) -> int:
    """Tokens of a UTF-8 text: starts of runs plus lone characters; in steps, so that long texts need little memory."""
    total, before = 0, 0
    for k in range(0, len(raw), step):
        c = classes[np.frombuffer(raw, np.uint8, min(step, len(raw) - k), k)]
        total += int(((c > 0) & (c != np.r_[np.int8(before), c[:-1]])).sum()) + int((c < 0).sum())
        before = c[-1]
    return total


def _counter(tokenizers: Mapping[str, Tokenizer]):
    """Column function: text -> number of tokens by each tokenizer, in order."""
    tables = [np.array(t.classes, np.int8) for t in tokenizers.values()]

    @F.pandas_udf("array<long>")
    def of(texts: pd.Series) -> pd.Series:
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        return pd.Series([[count_tokens(r, c) for c in tables] for r in raw], dtype=object)

    return of


def document_counts(
    docs: DataFrame,
    tokenizers: Mapping[str, Tokenizer] = TOKENIZERS,
    text_col: str = "text",
    keep: Sequence[str] = ("source", "lang"),
) -> DataFrame:
    """Per document: the columns ``keep``, its characters and its tokens by tokenizer. No text is carried on."""
    text = F.col(text_col)
    names = F.array(*[F.lit(n) for n in tokenizers])
    per = F.arrays_zip(names.alias("tokenizer"), _counter(tokenizers)(text).alias("tokens"))
    chars = F.coalesce(F.char_length(text), F.lit(0)).cast("long")
    return docs.select(*keep, chars.alias("chars"), per.alias("counts"))


def signed(counted: DataFrame, sign: int) -> DataFrame:
    """One row per document and tokenizer with its signed counts."""
    return counted.select("source", "lang", "chars", F.explode("counts").alias("t")).select(
        "source",
        "lang",
        "t.tokenizer",
        F.lit(sign).cast("long").alias("documents"),
        (F.col("t.tokens") * sign).alias("tokens"),
        (F.col("chars") * sign).alias("chars"),
    )


def inserts(docs: DataFrame, tokenizers: Mapping[str, Tokenizer] = TOKENIZERS, text_col: str = "text") -> DataFrame:
    return signed(document_counts(docs, tokenizers, text_col), 1)


def deletes(docs: DataFrame, tokenizers: Mapping[str, Tokenizer] = TOKENIZERS, text_col: str = "text") -> DataFrame:
    return signed(document_counts(docs, tokenizers, text_col), -1)


def revisions(docs: DataFrame, old: str, new: str, tokenizers: Mapping[str, Tokenizer] = TOKENIZERS) -> DataFrame:
    """Revised texts: the counts of column ``old`` go out, those of ``new`` come in."""
    return deletes(docs, tokenizers, old).unionByName(inserts(docs, tokenizers, new))


def later_copies(counted: DataFrame) -> DataFrame:
    """Deletes of the documents whose content a smaller doc_id has, as signed sums per key.

    ``counted`` has content and doc_id besides the counts. Documents of one content have the same
    counts, so a content needs its number of rows per source and language, and how many of
    them have the smallest id; these are combined before the shuffle, and a content of a third
    of all rows is one row per task, source and language. Rows without an id are no copies.
    """
    per = counted.select("content", "doc_id", "source", "lang", "chars", F.explode("counts").alias("t"))
    keys = ["content", "source", "lang", "tokenizer"]
    per = per.select(*keys[:3], "doc_id", "chars", "t.tokenizer", "t.tokens").groupBy(*keys, "doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("tokens").alias("tokens"), F.max("chars").alias("chars")
    )
    per = per.where("doc_id IS NOT NULL").groupBy(*keys).agg(
        F.sum("n").alias("n"),
        F.min(F.struct("doc_id", "n")).alias("low"),
        F.max("tokens").alias("tokens"),
        F.max("chars").alias("chars"),
    )
    first = F.min("low.doc_id").over(Window.partitionBy("content"))
    own = F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0)
    per = per.withColumn("first", first).withColumn("copies", F.col("n") - own).where("copies > 0")
    return per.select(
        "source",
        "lang",
        "tokenizer",
        (-F.col("copies")).alias("documents"),
        (-F.col("copies") * F.col("tokens")).alias("tokens"),
        (-F.col("copies") * F.col("chars")).alias("chars"),
    )


class Rollup:
    """A ledger of committed batches and their totals below ``path`` (on the shared store)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _batch(self, batch_id: str) -> str:
        return f"{self.path}/batches/{quote(batch_id, safe='')}"

    def _versions(self) -> list[str]:
        """Complete totals, oldest first; only the newest few are kept."""
        found = list_folders(self.spark, f"{self.path}/totals")
        return [v for v in found if is_complete(self.spark, f"{self.path}/totals/{v}")]

    def _head(self) -> tuple[int, str | None]:
        """Number and batch folder name of the newest totals."""
        versions = self._versions()
        return (int(versions[-1][2:8]), versions[-1][9:]) if versions else (0, None)

    def is_committed(self, batch_id: str) -> bool:
        return is_marked(self.spark, f"{self._batch(batch_id)}/_FOLDED") or self._head()[1] == quote(batch_id, safe="")

    def batches(self) -> set[str]:
        """Committed batch ids, by folder names."""
        return {b for b in map(unquote, list_folders(self.spark, f"{self.path}/batches")) if self.is_committed(b)}

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it has been committed before."""
        number, last = self._head()
        if last is not None:  # a commit may have broken off before its mark
            mark(self.spark, f"{self.path}/batches/{last}/_FOLDED")
        if self.is_committed(batch_id):
            return False
        sums = changes.groupBy(*KEYS).agg(*[F.sum(s).alias(s) for s in SUMS])
        sums.write.mode("overwrite").parquet(self._batch(batch_id))
        folded = self._summed(self.totals().unionByName(self._read(self._batch(batch_id))))
        used = [int(v[2:8]) for v in list_folders(self.spark, f"{self.path}/totals")]
        version = f"v={max([number, *used]) + 1:06d}-{quote(batch_id, safe='')}"
        folded.write.parquet(f"{self.path}/totals/{version}")
        mark(self.spark, f"{self._batch(batch_id)}/_FOLDED")
        for old in self._versions()[:-KEPT_TOTALS]:
            remove_path(self.spark, f"{self.path}/totals/{old}")
        return True

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(SIGNED).parquet(path)

    def _summed(self, rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*KEYS).agg(*[F.sum(s).alias(s) for s in SUMS])
        return sums.where(" OR ".join(f"{s} <> 0" for s in SUMS))

    def totals(self) -> DataFrame:
        """Current totals per (source, lang, tokenizer), as the last commit left them."""
        number, last = self._head()
        if last is None:
            return self.spark.createDataFrame([], SIGNED)
        return self._read(f"{self.path}/totals/v={number:06d}-{last}")

    def recounted(self) -> DataFrame:
        """The totals summed up anew over the whole ledger, to check them."""
        parts = [self._read(self._batch(b)) for b in sorted(self.batches())]
        return self._summed(reduce(DataFrame.unionByName, parts, self.spark.createDataFrame([], SIGNED)))

    def totals_by(self, *keys: str) -> DataFrame:
        """Totals rolled up to some of the keys; counts add up, so no document is read."""
        return self.totals().groupBy(*keys).agg(*[F.sum(s).alias(s) for s in SUMS])


def replay(rollup: Rollup, batches: Sequence[tuple[str, DataFrame]]) -> list[bool]:
    """Commit batches in order; which of them were new."""
    return [rollup.commit(k, changes) for k, changes in batches]
