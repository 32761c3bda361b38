import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillroll.operators.ranking import (
    global_rank,
    interpolated_quantiles,
    rank_bin,
    rank_score,
    value_bin,
    value_quantile_edges,
)


@pytest.mark.parametrize("parts", [1, 2, 8])
def test_global_rank_equals_row_number(spark, parts):
    df = spark.range(0, 5000).select(
        F.col("id").alias("k"), (F.col("id") % 7).alias("v")  # heavy ties
    ).repartition(parts)
    ranked = global_rank(df, ["v", "k"], "r")
    ref = df.withColumn("rn", F.row_number().over(Window.orderBy("v", "k")))
    joined = ranked.join(ref, ["k", "v"])
    assert joined.count() == 5000
    assert joined.where(F.col("r") != F.col("rn")).count() == 0


def _bin_sizes(spark, n, q=5):
    df = spark.range(1, n + 1).select(F.col("id").alias("r"), F.lit(n).alias("n"))
    got = df.groupBy(rank_bin("r", "n", q).alias("b")).count().orderBy("b").collect()
    return [row["count"] for row in got]


def test_rank_bins_are_not_ntile(spark):
    assert _bin_sizes(spark, 4279) == [856, 856, 855, 856, 856]
    assert _bin_sizes(spark, 7) == [2, 1, 1, 1, 2]  # edges 2.2, 3.4, 4.6, 5.8


def test_rank_bins_ties_follow_id_order(spark):
    # 7 customers with equal values: rank by CustomerID decides the bin
    df = spark.createDataFrame([(i, 10.0) for i in range(7, 0, -1)], "CustomerID long, v double")
    ranked = global_rank(df, ["v", "CustomerID"], "r", "n")
    got = {r["CustomerID"]: r["b"] for r in ranked.select("CustomerID", rank_bin("r", "n").alias("b")).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 3, 5: 4, 6: 5, 7: 5}


def test_value_bins_share_ties_and_match_linear_quantiles(spark):
    import numpy as np

    vals = [-1, -1, -2, -3, -3, -3, -10, -12, -40, -41, -41, -100]
    df = spark.createDataFrame([(v,) for v in vals], "x long")
    edges = value_quantile_edges(df, "x", 5)
    got = [r["b"] for r in df.select(value_bin("x", edges).alias("b")).collect()]
    inner = np.quantile(np.array(vals, dtype=float), [0.2, 0.4, 0.6, 0.8])
    expect = [1 + sum(v > e for e in inner) for v in vals]
    assert got == expect


def test_value_bins_raise_when_edges_coincide(spark):
    df = spark.createDataFrame([(0,)] * 10, "x long")
    with pytest.raises(ValueError):
        value_bin("x", value_quantile_edges(df, "x", 5))


def test_value_edges_with_many_distinct_values(spark):
    """One way for any number of distinct values: positions read from ranged counts."""
    import numpy as np

    rnd = random.Random(3)
    vals = [rnd.randint(-50_000, 0) for _ in range(3000)]
    df = spark.createDataFrame([(v,) for v in vals], "x long").repartition(7)
    exact = [lo + r * (hi - lo) / q for lo, hi, r, q in value_quantile_edges(df, "x", 5)]
    assert np.allclose(exact, np.quantile(vals, np.linspace(0, 1, 6)))


def test_interpolated_quantiles(spark):
    import numpy as np

    vals = [1.5, 1.5, 2.0, 9.0, 9.5, 40.0, -3.0]
    df = spark.createDataFrame([(v,) for v in [*vals, None]], "x double")
    qs = [0.0, 0.05, 0.5, 0.8, 1.0]
    assert np.allclose(interpolated_quantiles(df, "x", qs), np.quantile(vals, qs))
    assert interpolated_quantiles(df.where("x > 100"), "x", qs) is None


@pytest.mark.parametrize("n", [1, 2, 4, 7, 23])
def test_rank_score_equals_rank_bin(spark, n):
    rnd = random.Random(n)
    df = spark.createDataFrame([(i, rnd.randint(0, 3)) for i in range(n)], "id long, v int")
    ranked = global_rank(df, ["v", "id"], "r", "n")
    expect = {r["id"]: r["b"] for r in ranked.select("id", rank_bin("r", "n").alias("b")).collect()}
    got = {r["id"]: r["b"] for r in df.select("id", rank_score(df, ["v", "id"], n).alias("b")).collect()}
    assert got == expect
