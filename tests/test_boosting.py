"""The learner against a plain statement of leaf-wise boosting, and its shared rounds."""

import heapq

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.operators import boosting as B
from tillroll.operators import ltv as M
from tillroll.params import AnalysisParams

FEATURES = ("x", "y", "z")
P = AnalysisParams().with_(
    ltv_features=FEATURES, gbt_max_iter=6, gbt_max_leaves=6, gbt_min_rows_per_leaf=5, gbt_refresh=4, gbt_max_bins=16
)


def data(n=300, seed=1, missing=True):
    r = np.random.default_rng(seed)
    x, y = r.normal(size=(2, n)).round(2)
    z = r.integers(0, 4, n).astype(float)
    label = ((x + y * (z > 1) + r.normal(0, 0.4, n)) > 0.3).astype(int)
    if missing:
        y[r.random(n) < 0.15] = np.nan
    return x, y, z, label


def frame(spark, cols, members=None, parts=3):
    x, y, z, label = cols
    nan_to_none = lambda v: None if np.isnan(v) else float(v)
    rows = [
        (i, float(x[i]), nan_to_none(y[i]), float(z[i]), int(label[i]), 1 if members is None else int(members[i]))
        for i in range(len(x))
    ]
    ddl = "CustomerID long, x double, y double, z double, IsTopQuintileM int, member long"
    return spark.createDataFrame(rows, ddl).repartition(parts)


def plain_thresholds(v, max_bins):
    v = np.sort(v[~np.isnan(v)])
    distinct = np.unique(v)
    if len(distinct) <= max_bins:
        return (distinct[1:] + distinct[:-1]) / 2
    at = np.arange(1, max_bins) * (len(v) - 1) / max_bins
    return np.unique((v[np.floor(at).astype(int)] + v[np.ceil(at).astype(int)]) / 2)


def plain_boosting(cols, use, p):
    """Margins of all rows; every split found by trying all of them over the rows."""
    x, y, z, label = cols
    values = np.column_stack([x, y, z])
    cuts = [plain_thresholds(values[:, f], p.gbt_max_bins) for f in range(3)]
    n_pos = label[use].sum()
    margin = np.full(len(x), np.log((n_pos + 1e-9) / (use.sum() - n_pos + 1e-9)))

    def sides():
        for missing_left in (False, True):
            for f in range(3):
                for c in cuts[f]:
                    with np.errstate(invalid="ignore"):
                        yield np.where(np.isnan(values[:, f]), missing_left, values[:, f] <= c).astype(bool)
                if not missing_left:
                    yield ~np.isnan(values[:, f])

    all_sides = list(sides())
    for _ in range(p.gbt_max_iter):
        prob = 1 / (1 + np.exp(-margin))
        g, h = np.rint((prob - label) * 2**30) / 2**30, np.rint(prob * (1 - prob) * 2**30) / 2**30

        def best(rows):
            found, top = None, 1e-9
            score = lambda m: g[m].sum() ** 2 / h[m].sum()  # noqa: B023, E731
            for left in all_sides:
                a, b = rows & left & use, rows & ~left & use
                if min(a.sum(), b.sum()) >= p.gbt_min_rows_per_leaf:
                    gain = score(a) + score(b) - score(rows & use)  # noqa: B023
                    if gain > top + 1e-9:
                        found, top = left, gain
            return top, found

        everything = np.ones(len(x), bool)
        gain, left = best(everything)
        queue, leaves, k = [(-gain, 0, everything, left)], [], 1
        while queue:
            gain, _, rows, left = heapq.heappop(queue)
            if left is None or len(queue) + len(leaves) + 2 > p.gbt_max_leaves:
                leaves.append(rows)
                continue
            for side in (rows & left, rows & ~left):
                gain, split = best(side)
                if split is None:
                    leaves.append(side)
                else:
                    heapq.heappush(queue, (-gain, k, side, split))
                k += 1
        for rows in leaves:
            margin[rows] -= p.gbt_step_size * g[rows & use].sum() / h[rows & use].sum()
    return margin


def margins(model, cols):
    return model.margins(B.to_bins(np.column_stack(cols[:3]), model.thresholds))


@pytest.mark.parametrize("local_rows", [0, 90, 1 << 15])
@pytest.mark.parametrize("missing", [False, True])
def test_margins_equal_a_plain_statement(spark, missing, local_rows):
    """Rounds of histograms only, rows below small leaves, rows from the root on."""
    cols = data(missing=missing)
    model = M.fit(frame(spark, cols).drop("member"), P.with_(gbt_max_iter=4, gbt_local_rows=local_rows))
    use = np.ones(len(cols[0]), bool)
    assert np.allclose(margins(model, cols), plain_boosting(cols, use, P.with_(gbt_max_iter=4)), atol=1e-7)
    assert all(sum(k < 0 for k in t.left) <= P.gbt_max_leaves for t in model.trees)


def test_thresholds_are_exact_quantiles(spark):
    cols = data(seed=5)
    got = B.bin_thresholds(frame(spark, cols, parts=7), FEATURES, 16)
    for f in range(3):
        assert np.allclose(got[f], plain_thresholds(np.asarray(cols[f]), 16))


def test_models_trained_together_equal_models_trained_apart(spark):
    cols = data(400, 2)
    r = np.random.default_rng(3)
    member = r.integers(1, 8, 400)
    together = B.Boosting(frame(spark, cols, member), M.LABEL, "CustomerID", P, 3)
    models = together.fit()
    for m in range(3):
        use = (member >> m & 1) == 1
        assert np.allclose(margins(models[m], cols), plain_boosting(cols, use, P), atol=1e-7)
    # the stored margins give every left-out row its probability
    for row in together.left_out().collect():
        out = [m for m in range(3) if not member[row["id"]] >> m & 1]
        if out:
            assert row["model"] == out[0]
            own = [np.array([c[row["id"]]]) for c in cols]
            assert row["prob"] == pytest.approx(1 / (1 + np.exp(-margins(models[out[0]], own)[0])))


def test_trees_do_not_depend_on_partitions_or_order(spark):
    cols = data(500, 4)
    fits = [M.fit(frame(spark, cols, parts=k).drop("member"), P) for k in (1, 9)]
    fits.append(M.fit(frame(spark, cols).orderBy(F.desc("CustomerID")).drop("member"), P))
    assert fits[0].trees == fits[1].trees == fits[2].trees


def test_first_round_sums(spark):
    cols = data(200, 6)
    boosting = B.Boosting(frame(spark, cols), M.LABEL, "CustomerID", P, 1)
    got = {(r["feature"], r["bin"]): tuple(r[2:]) for r in boosting.first_histogram().collect()}
    label = cols[3]
    p = label.mean()
    bins = B.to_bins(np.column_stack(cols[:3]), boosting.models[0].model.thresholds)
    want = {}
    for f, name in enumerate(FEATURES):
        for b in np.unique(bins[:, f]):
            at = bins[:, f] == b
            want[name, int(b)] = (at.sum(), (p - label[at]).sum(), at.sum() * p * (1 - p))
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


def test_bins_of_edges_and_missing_values():
    edges = np.array([-1.0, 0.5, 2.0])
    values = np.array([[-5.0], [-1.0], [-0.5], [0.5], [1.0], [2.0], [9.0], [np.nan]])
    assert B.to_bins(values, [edges])[:, 0].tolist() == [0, 0, 1, 1, 2, 2, 3, 255]


def test_rescoring_equals_scoring_the_changed_rows(spark):
    """M9: walking only the trees that test a feature gives what scoring everything gives."""
    cols = data(240, 7)
    model = M.fit(frame(spark, cols).drop("member"), P)
    bins = B.to_bins(np.column_stack(cols[:3]), model.thresholds)
    r = np.random.default_rng(8)
    for f in range(3):
        changed = bins.copy()
        changed[:, f] = r.permutation(changed[:, f])
        parts = model.margins(bins, without=f) + model.margins(changed, only=f)
        assert np.allclose(parts, model.margins(changed), atol=1e-12)


def test_importance_uses_every_row_and_repeat(spark):
    p = P.with_(n_repeats=3)
    cols = data(150, 9)
    df = frame(spark, cols).drop("member")
    model = M.fit(df, p)
    got = {r["feature"]: r for r in M.permutation_importance(model, df, p).collect()}
    bins = B.to_bins(np.column_stack(cols[:3]), model.thresholds)
    # the same shuffles by hand: rows in hash order, a keyed bijection of their numbers
    order = [
        r["CustomerID"]
        for r in df.select("CustomerID", F.xxhash64("CustomerID", F.lit(p.seed)).alias("h")).orderBy("h", "CustomerID").collect()
    ]
    keys = M.shuffle_keys(150, 9, p.seed)

    def auc(score):
        wins = (score[cols[3] == 1][:, None] > score[cols[3] == 0]) + 0.5 * (score[cols[3] == 1][:, None] == score[cols[3] == 0])
        return wins.mean()

    plain = auc(1 / (1 + np.exp(-model.margins(bins))))
    for f, name in enumerate(FEATURES):
        drops = []
        for a, b in keys[3 * f : 3 * f + 3]:
            changed = bins.copy()
            for pos, customer in enumerate(order):
                changed[order[(a * pos + b) % 150], f] = bins[customer, f]
            drops.append(plain - auc(1 / (1 + np.exp(-model.margins(changed)))))
        assert got[name]["importance"] == pytest.approx(np.mean(drops), abs=1e-9)
        assert got[name]["std"] == pytest.approx(np.std(drops), abs=1e-9)


def test_partial_dependence_equals_one_score_per_grid_value(spark):
    p = P.with_(pd_grid_resolution=40)
    cols = data(200, 10)
    df = frame(spark, cols).drop("member")
    model = M.fit(df, p)
    bins = B.to_bins(np.column_stack(cols[:3]), model.thresholds)
    for f, name in enumerate(FEATURES):
        got = M.partial_dependence(model, df, name, p).collect()
        assert [r["grid_value"] for r in got] == M.dependence_grid(df, name, p)
        for r in got:
            changed = bins.copy()
            changed[:, f] = B.to_bins(np.array([[r["grid_value"]]]), model.thresholds[f : f + 1])[0, 0]
            want = (1 / (1 + np.exp(-model.margins(changed)))).mean()
            assert r["mean_probability"] == pytest.approx(want, abs=1e-12)
        assert len({r["mean_probability"] for r in got}) <= len(model.cuts(f)) + 1


def test_early_stopping_and_edge_cases(spark):
    cols = data(400, 11)
    p = P.with_(gbt_max_iter=200, gbt_early_stopping_rows=300, gbt_no_change=3, gbt_step_size=0.4)
    fits = [B.Boosting(frame(spark, cols), M.LABEL, "CustomerID", p.with_(gbt_local_rows=k), 1) for k in (1000, 0)]
    model = fits[0].fit()[0]
    assert 3 <= len(model.trees) < 200
    x = fits[0].models[0]
    assert min(x.losses[-3:]) > x.losses[-4] - 1e-7
    assert fits[1].fit()[0].trees == model.trees and fits[1].models[0].losses == x.losses
    one_class = (*cols[:3], np.ones(400, int))
    constant = M.fit(frame(spark, one_class).drop("member"), P)
    assert not constant.trees and constant.predict(frame(spark, one_class)).where("prob < 0.99").count() == 0
    same = (np.zeros(50), np.zeros(50), np.zeros(50), np.arange(50) % 2)
    flat = M.fit(frame(spark, same).drop("member"), P)
    assert set(flat.predict(frame(spark, same)).select("prob").distinct().toPandas()["prob"].round(6)) == {0.5}


def test_rounds_per_fit(spark):
    """Six models share their rounds: 100 trees of 31 leaves in far under 100 jobs a fit while the
    rows of a leaf may be read, under 200 if every tree starts with rounds of histograms; the
    bound on local rows changes no tree."""
    cols = data(1500, 12)
    p = P.with_(gbt_max_iter=12, gbt_max_leaves=31, gbt_min_rows_per_leaf=20, gbt_max_bins=255)
    member = np.array([sum(1 << m for m in range(6) if i % 6 != m) for i in range(1500)])
    fits = [B.Boosting(frame(spark, cols, member), M.LABEL, "CustomerID", p.with_(gbt_local_rows=k), 6) for k in (1 << 15, 400)]
    trees = [[m.trees for m in fit.fit()] for fit in fits]
    assert trees[0] == trees[1]
    per_fit = [fit.jobs * (100 / 12) / 6 for fit in fits]
    assert per_fit[0] < 25 and per_fit[1] < 200


def test_driver_reads_splits_only_and_rows_spread(spark, monkeypatch):
    """A round sends the driver splits: no histogram and no rows, however large the leaves are."""
    got, table = [], type(spark.range(1))
    read = table.toArrow
    monkeypatch.setattr(table, "toArrow", lambda self: got.append(read(self)) or got[-1])
    n = 24_000
    df = spark.range(0, n, 1, 1).select(
        F.col("id").alias("CustomerID"),
        *[F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000)).cast("double").alias(c) for k, c in enumerate(FEATURES)],
    )
    df = df.withColumn(M.LABEL, (F.col("x") + F.col("y") > 1100).cast("int")).withColumn("member", F.lit(3))
    for local_rows in (1 << 15, 2000):
        got.clear()
        fit = B.Boosting(df, M.LABEL, "CustomerID", P.with_(gbt_max_iter=3, gbt_max_bins=255, gbt_local_rows=local_rows), 2)
        files = fit.blocks.select(F.input_file_name()).distinct().count()
        assert files == min(spark.sparkContext.defaultParallelism, n // 4000)
        fit.fit()
        assert len(got) >= 3 and sum(t.nbytes for t in got) < 3 * 2 * P.gbt_max_leaves * 400
        assert not fit.persisted
    assert all(len(m.model.trees) == 3 for m in fit.models)


def test_importance_stores_no_copies_of_the_rows(spark, monkeypatch):
    """Several blocks of rows: the same drops as by hand, and nothing larger than the rows is stored."""
    from tillroll.operators import ranking

    stored = []

    def checkpoint(df):
        stored.append(df.count())
        return keep(df)

    keep = M.reliable_checkpoint
    for module in (M, ranking):
        monkeypatch.setattr(module, "reliable_checkpoint", checkpoint)
    n, p = 5000, P.with_(n_repeats=2)
    cols = data(n, 13)
    df = frame(spark, cols).drop("member")
    model = B.BoostedTrees(FEATURES, B.bin_thresholds(df, FEATURES, 16), 0.1)
    for f, cut in ((0, 9), (1, 6), (2, 1)):
        model.trees.append(B.Tree([f, 0, 0], [cut, 0, 0], [False] * 3, [1, -1, -1], [2, -1, -1], [0.0, -0.5 - f, 0.75]))
    got = {r["feature"]: r["importance"] for r in M.permutation_importance(model, df, p).collect()}
    assert max(stored) <= n
    bins = B.to_bins(np.column_stack(cols[:3]), model.thresholds)
    order = np.array(
        [r[0] for r in df.select("CustomerID", F.xxhash64("CustomerID", F.lit(p.seed)).alias("h")).orderBy("h", "CustomerID").collect()]
    )

    def auc(score):
        ranks = np.unique(score, return_inverse=True)[1]
        below = np.bincount(ranks).cumsum()
        mean_rank = below - (np.bincount(ranks) - 1) / 2
        pos = cols[3] == 1
        return (mean_rank[ranks][pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())

    keys = M.shuffle_keys(n, 6, p.seed)
    for f, name in enumerate(FEATURES):
        drops = []
        for a, b in keys[2 * f : 2 * f + 2]:
            changed = bins.copy()
            changed[order[(a * np.arange(n) + b) % n], f] = bins[order, f]
            drops.append(auc(model.margins(bins)) - auc(model.margins(changed)))
        assert got[name] == pytest.approx(np.mean(drops), abs=1e-9)


def test_guessed_splits_save_rounds_and_change_no_tree(spark, monkeypatch):
    """A round answers the nodes below an asked one where the guess is its best split; a wrong guess costs nothing."""
    cols = data(1500, 14)
    p = P.with_(gbt_max_iter=8, gbt_max_leaves=12, gbt_local_rows=60, gbt_max_bins=64)
    member = np.array([1 + 2 * (i % 3 > 0) for i in range(1500)])

    def fit():
        out = B.Boosting(frame(spark, cols, member), M.LABEL, "CustomerID", p, 2)
        return [m.trees for m in out.fit()], out.jobs

    def wrong(self, seen):
        t = self.tree
        out = B.Tree(*(list(c) for c in (t.feature, t.bin, t.missing_left, t.left, t.right, t.value)))
        for node in self.asked:
            out.feature[node], out.bin[node], out.left[node], out.right[node] = 2, 200, out.add(), out.add()
        return out

    trees, jobs = fit()
    monkeypatch.setattr(B.GrowingTree, "with_guesses", lambda self, seen: self.tree, raising=False)
    plain, plain_jobs = fit()
    monkeypatch.setattr(B.GrowingTree, "with_guesses", wrong, raising=False)
    misled, misled_jobs = fit()
    assert trees == plain == misled
    assert jobs < plain_jobs == misled_jobs


def test_a_round_reads_the_margins_of_its_models_only(spark):
    cols = data(300, 15)
    fit = B.Boosting(frame(spark, cols, np.full(300, 7)), M.LABEL, "CustomerID", P, 3)
    sent = fit._sent(fit._tasks()[1:2])
    read = sent._jdf.queryExecution().executedPlan().toString().split("ReadSchema:")[1]
    assert "margin1" in read and "margin0" not in read and "margin2" not in read and ",id:" not in read
