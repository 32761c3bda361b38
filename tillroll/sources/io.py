"""Sources and sinks (IO1-IO7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..params import AnalysisParams
from .schema import CLEAN_COLUMNS, CUSTOMER_COLUMNS, LINE_ITEM_SCHEMA


#: Partition column of stored line items: ``yyyy-MM`` of ``InvoiceDate``.
MONTH = "invoice_month"


def _aligned(df: DataFrame, name: str, kind: T.DataType) -> Column:
    """A column in the fixed type; values that the type cannot hold raise instead of changing."""
    c = F.col(name)
    if df.schema[name].dataType == kind:
        return c
    narrowed = c.cast(kind)
    if isinstance(kind, T.IntegralType):
        lost = c.isNotNull() & (narrowed.isNull() | (narrowed.cast("double") != c.cast("double")))
        message = F.concat(F.lit(f"{name} does not fit {kind.simpleString()}: "), c.cast("string"))
        return F.when(lost, F.raise_error(message).cast(kind)).otherwise(narrowed)
    return narrowed


def load_line_items(
    spark: SparkSession, path: str, fmt: str = "parquet", params: AnalysisParams | None = None, **options
) -> DataFrame:
    """IO1/IO2: read line items with the fixed schema; timestamps parsed by the schema.

    CSV input is read with ``timestampNTZFormat`` so ``InvoiceDate`` lands as
    ``timestamp_ntz`` without inference. With ``params``, a table stored by month
    (``write_line_items``) is read for the months of the analysis window only; the rows
    inside the window are the same.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.schema(LINE_ITEM_SCHEMA).option("header", True)
        reader = reader.option("timestampNTZFormat", options.pop("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss"))
    for k, v in options.items():
        reader = reader.option(k, v)
    df = reader.load(path)
    if params is not None and MONTH in df.columns:
        month = F.substring(F.col(MONTH).cast("string"), 1, 7)
        first, last = (t.strftime("%Y-%m") for t in (params.start_ts, params.end_ts))
        df = df.where((month >= first) & (month <= last))
    # Parquet/ORC carry their own types: align to the fixed schema by name.
    return df.select(*[_aligned(df, f.name, f.dataType).alias(f.name) for f in LINE_ITEM_SCHEMA.fields])


def write_line_items(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Store line items partitioned by invoice month so window trims prune partitions.

    ``REBALANCE`` gathers a month in few files but splits a large month over as many tasks
    as its size asks for.
    """
    (
        df.withColumn(MONTH, F.date_format("InvoiceDate", "yyyy-MM"))
        .hint("rebalance", MONTH)
        .write.mode(mode)
        .partitionBy(MONTH)
        .parquet(path)
    )


def _writer(df: DataFrame, fmt: str, mode: str):
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss")
    return w


def write_clean(df_clean: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """IO3: the 10-column cleaned export, fixed order, header, no index."""
    out = df_clean.select(*CLEAN_COLUMNS).withColumn("LineRevenue", F.col("LineRevenue").cast("double"))
    _writer(out, fmt, mode).save(path)


def write_customers(customers: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """IO4: the 19-column customer frame."""
    _writer(customers.select(*CUSTOMER_COLUMNS), fmt, mode).save(path)


def write_segment_map(segment_map: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO5: JSON records R, F, M, Segment (125 rows; one file)."""
    segment_map.select("R", "F", "M", "Segment").orderBy("R", "F", "M").coalesce(1).write.mode(mode).json(path)


def write_summary(summary: DataFrame, path: str, mode: str = "overwrite") -> None:
    """IO6: the one-row nested summary as JSON."""
    summary.coalesce(1).write.mode(mode).json(path)


def read_json_result(
    spark: SparkSession, path: str, multi_line: bool = False, schema: T.StructType | None = None
) -> DataFrame:
    """IO7: read a written JSON result back: JSON lines, or one multi-line document."""
    reader = spark.read.option("multiLine", multi_line)
    return (reader.schema(schema) if schema is not None else reader).json(path)
