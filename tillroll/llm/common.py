"""Shared pieces of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: A word: a run of anything but space and the ASCII control white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows without a doc_id sort after every id.
LAST = (1 << 63) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet below the shared checkpoint folder and read it again.

    Cuts the lineage: every later read, also after the loss of an executor, sees the same
    rows. The folder is the session's ``spark.checkpoint.dir`` (only local sessions
    without one get their own).
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def order_id(doc_id: str = "doc_id") -> Column:
    """``doc_id`` as an order in which missing ids come last."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(LAST))


def text_words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8; ``bytes.split`` cuts at exactly space and \\t..\\r."""
    return text.encode("utf-8", "surrogatepass").split() if text else []
