"""Published customer tables: joins without a shuffle, whole versions only."""

import uuid

import pytest
from pyspark.sql import functions as F

from tillroll.sources import published


@pytest.fixture
def name(spark):
    name = f"customers_{uuid.uuid4().hex}"
    yield name
    spark.sql(f"DROP VIEW IF EXISTS {name}")
    for v in published._versions(spark, name):
        spark.sql(f"DROP TABLE IF EXISTS {v}")


def frame(spark, n, value=1):
    return spark.range(n).select(F.col("id").alias("CustomerID"), F.lit(value).alias("v"))


def final_plan(df):
    df._jdf.queryExecution().toRdd().count()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_joins_and_aggregates_by_customer_need_no_shuffle(spark, name, tmp_path):
    other = f"{name}_months"
    published.publish(frame(spark, 500), name, str(tmp_path), 4)
    months = frame(spark, 1500).select((F.col("CustomerID") % 500).alias("CustomerID"), F.col("CustomerID").alias("month"))
    version = published.publish(months, other, str(tmp_path), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table(name).join(spark.table(other), "CustomerID").groupBy("CustomerID").agg(F.count("month").alias("n"))
        plan = final_plan(joined)
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert joined.agg(F.sum("n"), F.count("*")).first() == (1500, 500)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql(f"DROP VIEW {other}")
        spark.sql(f"DROP TABLE {version}")


def test_versions_move_the_view_when_they_are_whole(spark, name, tmp_path):
    first = published.publish(frame(spark, 10, 1), name, str(tmp_path), 2)
    assert spark.table(name).agg(F.max("v")).first()[0] == 1
    begun = spark.table(name)
    broken = frame(spark, 10, 2).withColumn("v", F.when(F.col("CustomerID") == 7, F.raise_error(F.lit("lost")).cast("int")).otherwise(2))
    with pytest.raises(Exception, match="lost"):
        published.publish(broken, name, str(tmp_path), 2)
    assert spark.table(name).agg(F.max("v"), F.count("*")).first() == (1, 10)  # the torn write is not read
    second = published.publish(frame(spark, 10, 3), name, str(tmp_path), 2)
    assert second != first and spark.table(name).agg(F.max("v")).first()[0] == 3
    assert begun.agg(F.max("v")).first()[0] == 1  # a reader that has begun keeps its version
    third = published.publish(frame(spark, 10, 4), name, str(tmp_path), 2)
    assert published._versions(spark, name) == [second, third]
    assert not (tmp_path / first).exists() and (tmp_path / second).exists()
