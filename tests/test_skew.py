"""A key holding a third of all rows must not land in one task."""

from pyspark.sql import functions as F

from tests.helpers import frame, line
from tillroll.operators import clean as CL
from tillroll.operators import customers as CU
from tillroll.params import AnalysisParams


def test_range_sort_splits_a_tie_group_holding_a_third(spark):
    n = 30000
    # a third of the rows share one value (e.g. Frequency = 1)
    df = spark.range(n).select(
        F.col("id").alias("CustomerID"), F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 997 + 2).alias("v")
    )
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # keep the 8 range partitions AQE would merge at this size
    try:
        tagged = df.repartition(8).orderBy("v", "CustomerID").select(F.spark_partition_id().alias("p"))
        sizes = [r["count"] for r in tagged.groupBy("p").count().collect()]
    finally:
        spark.conf.set(key, before)
    assert sum(sizes) == n
    assert max(sizes) < n / 3  # the hot tie group is spread over several range partitions


def test_hot_customer_aggregates_partially_before_the_shuffle(spark):
    P = AnalysisParams()
    hot = [line(str(i), str(i % 50), 1, "2011-05-01 10:00:00", 1.0, 1) for i in range(3000)]
    cold = [line(str(10000 + i), "A1", 2, "2011-06-01 10:00:00", 1.5, 100 + i % 600) for i in range(6000)]
    df = CL.with_customer(CL.clean_line_items(frame(spark, hot + cold).repartition(8), P))
    feats = CU.customer_features(df, P)
    plan = feats._jdf.queryExecution().executedPlan().toString()
    got = {r["CustomerID"]: r for r in feats.collect()}
    assert got[1]["Frequency"] == 3000 and got[1]["DistinctStockCodes"] == 50 and got[1]["TotalLines"] == 3000
    assert float(got[1]["Monetary"]) == 3000.0
    assert len(got) == 601
    # map-side partial aggregation precedes every exchange keyed by CustomerID
    assert "partial_" in plan
