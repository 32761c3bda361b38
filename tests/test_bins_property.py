"""Property tests: the integer bin rules equal pandas' qcut on the same inputs."""

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tillroll.operators.ranking import rank_bin, value_bin, value_quantile_edges


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(n=st.integers(min_value=2, max_value=3000))
def test_rank_bins_equal_qcut_of_ranks(spark, n):
    expect = pd.qcut(pd.Series(range(1, n + 1), dtype=float), q=5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    df = spark.range(1, n + 1).select(F.col("id").alias("r"))
    got = [r["b"] for r in df.select(rank_bin("r", F.lit(n)).alias("b")).orderBy("r").collect()]
    assert got == expect


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=st.lists(st.integers(min_value=-400, max_value=0), min_size=5, max_size=300))
def test_value_bins_equal_qcut(spark, vals):
    try:
        expect = pd.qcut(pd.Series(vals), q=5, labels=[1, 2, 3, 4, 5]).astype(int).tolist()
    except ValueError:
        expect = None
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i long, x long")
    try:
        edges = value_quantile_edges(df, "x", 5)
        got = [r["b"] for r in df.select("i", value_bin("x", edges).alias("b")).orderBy("i").collect()]
    except ValueError:
        got = None
    assert got == expect
