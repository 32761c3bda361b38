"""Customer tables published for readers: bucketed and sorted by customer, in whole versions.

Tables with one key per customer (the customer frame, its active months) are written in as
many buckets by the same key, so a join of two of them, or an aggregate by customer, needs
no shuffle. Every write is a table of its own, ``<name>_v000001`` and on; the view
``<name>`` names the version that counts and moves only when a write has ended, so a write
that breaks off is never read. The version before stays for readers that have begun.

Bucketing puts all rows of a customer into one file, so it is for tables with few rows per
customer (one, or one per month); line items stay in months (``io.write_line_items``).
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..session import remove_path

KEY = "CustomerID"


def _versions(spark: SparkSession, name: str) -> list[str]:
    pattern = re.compile(rf"{re.escape(name)}_v\d{{6}}")
    return sorted(t.name for t in spark.catalog.listTables() if pattern.fullmatch(t.name))


def publish(df: DataFrame, name: str, folder: str, buckets: int, key: str = KEY) -> str:
    """Write a new version below ``folder`` and let the view ``name`` read it; the version's table name."""
    spark = df.sparkSession
    known = _versions(spark, name)
    version = f"{name}_v{int(known[-1][-6:]) + 1 if known else 1:06d}"
    path = f"{folder.rstrip('/')}/{version}"
    remove_path(spark, path)  # what a write that broke off may have left
    # a task per bucket, so a file per bucket
    dealt = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    dealt.format("parquet").option("path", path).saveAsTable(version)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM {version}")
    for old in known[:-1]:
        drop_version(spark, old, f"{folder.rstrip('/')}/{old}")
    return version


def drop_version(spark: SparkSession, version: str, path: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {version}")
    remove_path(spark, path)
