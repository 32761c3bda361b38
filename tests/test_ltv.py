import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from tillroll.operators import ltv as M
from tillroll.params import AnalysisParams
from tillroll.plans.analysis import RetailAnalysis


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return wins / (len(pos) * len(neg))


def test_rank_sum_auc_matches_brute_force(spark):
    rnd = random.Random(7)
    rows = []
    for g in range(3):
        for i in range(60):
            y = rnd.random() < 0.3
            s = round(rnd.random() * (0.6 if not y else 1.0), 1)  # many ties
            rows.append((g, i + 100 * g, s, int(y)))
    df = spark.createDataFrame(rows, "g int, id long, s double, y int")
    got = {r["g"]: r["auc"] for r in M.auc_by_group(df, ["g"], "s", "y", "id").collect()}
    for g in range(3):
        sub = [(s, y) for gg, _, s, y in rows if gg == g]
        assert abs(got[g] - brute_auc([s for s, _ in sub], [y for _, y in sub])) < 1e-12


def test_model_workflow_small(spark):
    a = RetailAnalysis.from_test_tables(spark, SF001)
    p = a.params.with_(gbt_max_iter=5, n_repeats=2, pd_grid_resolution=5)
    try:
        frame = M.model_frame(a.scored, p)
        n = frame.count()
        folded = M.stratified_folds(frame, p)
        per = {(r["fold"], r[M.LABEL]): r["count"] for r in folded.groupBy("fold", M.LABEL).count().collect()}
        for y in (0, 1):
            sizes = [per.get((k, y), 0) for k in range(p.n_folds)]
            assert max(sizes) - min(sizes) <= 1  # stratified
        again = M.stratified_folds(frame, p)
        assert folded.join(again, ["CustomerID", "fold"]).count() == n  # seeded, repeatable
        r = M.ltv_study(a.scored, p)
        c = r.confusion.first()
        assert sum(c) == n
        auc = r.auc.first()
        assert auc["roc_auc_mean"] > 0.8
        assert r.importance.count() == len(p.ltv_features)
        assert len(r.top2_non_rfm) == 2 and not set(r.top2_non_rfm) & set(p.rfm_features)
        for f, pdf in r.pd.items():
            assert pdf.count() >= 1
            assert pdf.where((F.col("mean_probability") < 0) | (F.col("mean_probability") > 1)).count() == 0
    finally:
        a.close()


@pytest.mark.parametrize("share", [0.1, 0.2, 0.25, 0.3, 0.5])
def test_holdout_share_is_honoured_in_each_label(spark, share):
    p = AnalysisParams().with_(test_share=share)
    df = spark.range(137).select(F.col("id").alias("CustomerID"), (F.col("id") % 5 == 0).cast("int").alias(M.LABEL))
    train, held = M.holdout_split(df, p)
    assert train.count() + held.count() == 137 and train.join(held, "CustomerID").count() == 0
    for y, n in ((1, 28), (0, 109)):
        assert held.where(F.col(M.LABEL) == y).count() == int(share * n + 0.5)


def test_dependence_grid(spark):
    """Distinct values only if there are fewer of them than points; else exact percentiles."""
    p = AnalysisParams().with_(pd_grid_resolution=5)
    few = spark.createDataFrame([(float(k % 4),) for k in range(40)], "x double")
    assert M.dependence_grid(few, "x", p) == [0.0, 1.0, 2.0, 3.0]
    as_many = [float(k % 5) for k in range(43)]
    grid = M.dependence_grid(spark.createDataFrame([(v,) for v in as_many], "x double"), "x", p)
    assert np.allclose(grid, np.linspace(*np.quantile(as_many, [0.05, 0.95]), 5))


def test_shuffle_keys_are_bijections():
    for n in (1, 2, 9, 100):
        for a, b in M.shuffle_keys(n, 20, 1):
            assert sorted((a * k + b) % n for k in range(n)) == list(range(n))


def test_importance_of_the_only_informative_feature(spark):
    p = AnalysisParams().with_(ltv_features=("x", "noise"), gbt_max_iter=5, n_repeats=3, gbt_min_rows_per_leaf=1)
    df = spark.range(400).select(
        F.col("id").alias("CustomerID"),
        F.col("id").cast("double").alias("x"),
        (F.xxhash64("id") % 10).cast("double").alias("noise"),
        (F.col("id") > 250).cast("int").alias(M.LABEL),
    )
    found = {r["feature"]: r["importance"] for r in M.permutation_importance(M.fit(df, p), df, p).collect()}
    assert found["x"] > 0.3 and abs(found["noise"]) < 0.05


def test_empty_customers(spark):
    scored = spark.createDataFrame([], "CustomerID long, Monetary double")
    assert M.high_value_threshold(scored, AnalysisParams()) is None
