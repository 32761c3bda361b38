import tempfile

from pyspark.sql import functions as F

from tests.conftest import SF001
from tests.helpers import frame, line
from tillroll.operators.rfm import segment_map
from tillroll.operators.summary import SUMMARY_SCHEMA, summary_frame, top_segments_report
from tillroll.plans.analysis import RetailAnalysis
from tillroll.sources import io


def test_line_item_round_trip_csv_and_parquet(spark):
    rows = [
        line("536365", "85123A", 6, "2010-12-01 08:26:00", 2.55, 17850, desc="WHITE HANGING HEART"),
        line("C536379", "D", -1, "2010-12-01 09:41:00", 27.5, None, "France"),
    ]
    df = frame(spark, rows)
    d = tempfile.mkdtemp(prefix="tillroll-io-")
    df.write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{d}/csv")
    back = io.load_line_items(spark, f"{d}/csv", "csv")
    assert sorted(back.collect()) == sorted(df.collect())
    io.write_line_items(df, f"{d}/pq")
    back = io.load_line_items(spark, f"{d}/pq", "parquet")
    assert sorted(back.collect()) == sorted(df.collect())


def test_exports_and_summary(spark):
    d = tempfile.mkdtemp(prefix="tillroll-io-")
    a = RetailAnalysis.from_test_tables(spark, SF001)
    try:
        io.write_clean(a.clean, f"{d}/clean", fmt="csv")
        clean = spark.read.option("header", True).csv(f"{d}/clean")
        assert clean.columns[:2] == ["InvoiceNo", "StockCode"] and len(clean.columns) == 10
        assert clean.count() == a.clean.count()
        io.write_customers(a.customers, f"{d}/customers")
        assert len(spark.read.parquet(f"{d}/customers").columns) == 19
        io.write_segment_map(segment_map(spark), f"{d}/segmap")
        sm = io.read_json_result(spark, f"{d}/segmap")
        assert sm.count() == 125
        doc = summary_frame(a)
        io.write_summary(doc, f"{d}/summary")
        back = io.read_json_result(spark, f"{d}/summary", schema=SUMMARY_SCHEMA)
        r, own = back.first(), doc.first()
        assert r["kpis"] == own["kpis"] and r["segments"] == own["segments"]
        assert r["cleaning"]["03_drop_exact_duplicates"]["rows_after"] == a.clean.count()
        from tillroll.operators.summary import guard_rails_from_summary

        rails = {r["check_name"]: r["status"] for r in guard_rails_from_summary(back, a.params).collect()}
        direct = {r["check_name"]: r["status"] for r in a.guard_rails().collect()}
        assert rails == direct and len(rails) == 4
        top = top_segments_report(back, 6).collect()
        assert top[0]["width_pct"] == 100.0
        assert top[0]["Segment"] == own["top_segment"]["name"]
    finally:
        a.close()


def test_fixed_table_schemas_match_the_files(spark):
    """The declared read schemas equal the inferred types of the columns the view uses."""
    from pyspark.sql.types import StructType

    from tillroll.sources.tpch_adapter import TABLE_SCHEMAS, read_tables

    tables = read_tables(spark, SF001)
    for name, ddl in TABLE_SCHEMAS.items():
        declared = StructType.fromDDL(ddl)
        inferred = spark.read.parquet(f"{SF001}/{name}.parquet").select(*declared.fieldNames()).schema
        assert [(f.name, f.dataType) for f in declared] == [(f.name, f.dataType) for f in inferred], name
        assert tables[name].count() == spark.read.parquet(f"{SF001}/{name}.parquet").count()


def test_window_load_prunes_months_and_keeps_the_rows(spark):
    from tillroll.operators.clean import trim_window
    from tillroll.params import test_table_params
    from tillroll.sources.tpch_adapter import line_items

    d = tempfile.mkdtemp(prefix="tillroll-io-")
    p = test_table_params()
    io.write_line_items(line_items(spark, SF001), f"{d}/pq")
    trimmed = trim_window(io.load_line_items(spark, f"{d}/pq", params=p), p)
    plan = trimmed._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "invoice_month" in filters
    whole = trim_window(io.load_line_items(spark, f"{d}/pq"), p)
    assert sorted(map(str, trimmed.collect())) == sorted(map(str, whole.collect()))
    files = trimmed.select(F.input_file_name()).distinct().collect()
    months = {r[0].split("invoice_month=")[1][:7] for r in files}
    assert months == {f"1997-{m:02d}" for m in range(1, 13)}


def test_one_month_is_written_by_several_tasks(spark):
    d = tempfile.mkdtemp(prefix="tillroll-io-")
    rows = [line(str(k), f"code{k}", 1, "2011-03-05 10:00:00", 1.0, k) for k in range(4000)]
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        io.write_line_items(frame(spark, rows).repartition(16), f"{d}/pq")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
    back = spark.read.parquet(f"{d}/pq")
    assert back.count() == 4000
    assert len(back.inputFiles()) > 1


def test_load_widens_or_fails_but_never_narrows(spark):
    import pytest

    d = tempfile.mkdtemp(prefix="tillroll-io-")
    df = frame(spark, [line("1", "a", 2, "2011-01-01 00:00:00", 1.0, 5)])
    df.withColumn("Quantity", F.col("Quantity").cast("int")).write.parquet(f"{d}/int")
    assert io.load_line_items(spark, f"{d}/int").first()["Quantity"] == 2
    df.withColumn("Quantity", F.lit(2.0)).write.parquet(f"{d}/whole")
    assert io.load_line_items(spark, f"{d}/whole").first()["Quantity"] == 2
    df.withColumn("Quantity", F.lit(2.5)).write.parquet(f"{d}/fraction")
    with pytest.raises(Exception, match="does not fit"):
        io.load_line_items(spark, f"{d}/fraction").collect()


def test_summary_schema_does_not_depend_on_the_data(spark):
    a = RetailAnalysis.from_test_tables(spark, SF001, cache=False)
    few = RetailAnalysis(a.raw.where("CustomerID < 12"), a.params, cache=False)
    both = [summary_frame(x) for x in (a, few)]
    assert [f.dataType for f in both[0].schema] == [f.dataType for f in SUMMARY_SCHEMA]
    union = both[0].unionByName(both[1]).collect()
    assert len(union[1]["segments"]) < len(union[0]["segments"])
