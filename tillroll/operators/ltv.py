"""High-value-customer model.

The learner is ``boosting``: histogram trees grown leaf by leaf, with the reference's
settings; its seeded random choices (folds, hold-out rows, shuffles) cannot be matched row
for row. The workflow is the same: top-quantile label, stratified seeded folds, out-of-fold
metrics, a stratified hold-out for permutation importance, partial dependence of the two
strongest non-RFM features. The fold models and the hold-out model are grown together.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import AnalysisParams
from ..session import reliable_checkpoint
from .boosting import BoostedTrees, Boosting, _sigmoid, to_bins
from .ranking import global_rank, interpolated_quantiles

LABEL = "IsTopQuintileM"


# ---------------------------------------------------------------- M1, W4, P18
def high_value_threshold(scored: DataFrame, params: AnalysisParams) -> float | None:
    """Exact linear-interpolation quantile of Monetary; None without customers."""
    found = interpolated_quantiles(scored, "Monetary", [params.high_value_quantile])
    return found[0] if found else None


def model_frame(scored: DataFrame, params: AnalysisParams, threshold: float | None = None) -> DataFrame:
    """M1: CustomerID, the numeric features as double, label ``Monetary >= q``."""
    q = threshold if threshold is not None else high_value_threshold(scored, params)
    return scored.select(
        "CustomerID",
        *[F.col(c).cast("double").alias(c) for c in params.ltv_features],
        (F.col("Monetary").cast("double") >= F.lit(q)).cast("int").alias(LABEL),
    )


# ---------------------------------------------------------------------- M2, M8
def _order_in_label(frame: DataFrame, seed: int) -> DataFrame:
    """Adds ``_r``: position from 0 inside the label, in the order of xxhash64(id, seed).

    The order, and so every split made from it, does not depend on the partitioning.
    """
    h = F.xxhash64(F.col("CustomerID"), F.lit(seed))
    ranked = global_rank(frame.withColumn("_h", h), [LABEL, "_h", "CustomerID"], "_r")
    n_neg = frame.where(F.col(LABEL) == 0).count()
    return ranked.withColumn(
        "_r", F.col("_r") - 1 - F.when(F.col(LABEL) == 1, F.lit(n_neg)).otherwise(F.lit(0))
    ).drop("_h")


def stratified_folds(frame: DataFrame, params: AnalysisParams, fold_col: str = "fold") -> DataFrame:
    """M2: seeded stratified k-fold: rows of each label are dealt round-robin into folds."""
    return _order_in_label(frame, params.seed).withColumn(fold_col, (F.col("_r") % params.n_folds).cast("int")).drop("_r")


def _held(frame: DataFrame, params: AnalysisParams) -> Column:
    """The row is one of the first round(share x rows) of its label."""
    sizes = {r[LABEL]: r["count"] for r in frame.groupBy(LABEL).count().collect()}  # two rows
    cut = F.lit(0)
    for label, n in sizes.items():
        cut = F.when(F.col(LABEL) == label, F.lit(math.floor(params.test_share * n + 0.5))).otherwise(cut)
    return F.col("_r") < cut


def holdout_split(frame: DataFrame, params: AnalysisParams) -> tuple[DataFrame, DataFrame]:
    """M8: stratified train / hold-out split: of each label the first round(share x rows) are held out."""
    ordered = _order_in_label(frame, params.seed)
    ordered = ordered.withColumn("_held", _held(frame, params)).drop("_r")
    return ordered.where(~F.col("_held")).drop("_held"), ordered.where("_held").drop("_held")


def folds_and_holdout(frame: DataFrame, params: AnalysisParams) -> DataFrame:
    """M2 + M8 from one order: the frame with ``fold`` and ``held``."""
    ordered = _order_in_label(frame, params.seed)
    fold = (F.col("_r") % params.n_folds).cast("int")
    return ordered.withColumns({"fold": fold, "held": _held(frame, params)}).drop("_r")


# ---------------------------------------------------------------------- M3, M5
def fit(train: DataFrame, params: AnalysisParams) -> BoostedTrees:
    """M3: one model on all rows of ``train``."""
    return Boosting(train.withColumn("member", F.lit(1)), LABEL, "CustomerID", params, 1).fit()[0]


class StudyFit:
    """M3 + M5: the k fold models and the hold-out model, grown in the same rounds.

    Model m < k trains on the rows outside fold m, model k on the rows that are not held out.
    """

    def __init__(self, assigned: DataFrame, params: AnalysisParams):
        k = params.n_folds
        member = F.when(F.col("held"), 0).otherwise(1 << k)
        for m in range(k):
            member = member.bitwiseOR(F.when(F.col("fold") != m, 1 << m).otherwise(0))
        self.assigned = assigned
        self.boosting = Boosting(assigned.withColumn("member", member), LABEL, "CustomerID", params, k + 1)
        self.models = self.boosting.fit()

    @property
    def holdout_model(self) -> BoostedTrees:
        return self.models[-1]

    def out_of_fold(self) -> DataFrame:
        """CustomerID, fold, label, prob and prediction of the model that did not see the row's fold.

        The probabilities come from the margins that the training kept; no model scores a row again.
        """
        left_out = self.boosting.left_out().select(F.col("id").alias("_id"), "prob")
        rows = self.assigned.select("CustomerID", "fold", LABEL)
        return rows.join(left_out, F.col("CustomerID") == F.col("_id")).select(
            "CustomerID", "fold", LABEL, "prob", (F.col("prob") > 0.5).cast("int").alias("prediction")
        )


# ------------------------------------------------------------------------ AUC
def auc_by_group(pred: DataFrame, group_cols: list[str], score_col: str, label_col: str, id_col: str | None = None) -> DataFrame:
    """ROC-AUC per group by the rank-sum rule with average ranks for tied scores.

    Rows of one (group, score) share a rank, so they are counted first and many ties make one
    row; the order of their ids (``id_col``) does not matter. The counts are ranged over partitions by (group,
    score), so no group is gathered into a single task, and every partition adds up its part of
    a group: rows, positives and the rank sum from the partition's first row on. Only these
    few rows are shifted by the rows of the partitions before.
    """
    counted = pred.groupBy(*group_cols, score_col).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(label_col).cast("long")).alias("_pos")
    )
    ranged = counted.repartitionByRange(*group_cols, score_col).sortWithinPartitions(*group_cols, score_col)
    ranged = ranged.select(*group_cols, "_n", "_pos", F.spark_partition_id().alias("_part"))

    def parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict = {}  # by group
        for pdf in batches:
            for group, rows in pdf.groupby([*group_cols, "_part"], sort=False):
                before, pos, ranks = found.get(group, (0, 0, 0.0))
                n, p = rows["_n"].to_numpy(), rows["_pos"].to_numpy()
                first = before + n.cumsum() - n
                ranks += float((p * (first + (n + 1) / 2.0)).sum())  # the average rank of a tie
                found[group] = before + int(n.sum()), pos + int(p.sum()), ranks
        yield pd.DataFrame([(*k, *v) for k, v in found.items()], columns=[*group_cols, "_part", "_n", "_pos", "_ranks"])

    ddl = ", ".join(f"`{c}` {pred.schema[c].dataType.simpleString()}" for c in group_cols)
    partial = ranged.mapInPandas(parts, f"{ddl}, _part int, _n long, _pos long, _ranks double")
    # at most a row per group and partition
    before = F.sum("_n").over(Window.partitionBy(*group_cols).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    sums = (
        partial.withColumn("_before", F.coalesce(before, F.lit(0)))
        .groupBy(*group_cols)
        .agg(
            F.sum(F.col("_ranks") + F.col("_pos") * F.col("_before")).alias("_rsum"),
            F.sum("_pos").cast("double").alias("_P"),
            (F.sum("_n") - F.sum("_pos")).cast("double").alias("_N"),
        )
    )
    return sums.select(
        *group_cols,
        F.when(
            (F.col("_P") > 0) & (F.col("_N") > 0),
            (F.col("_rsum") - F.col("_P") * (F.col("_P") + 1) / 2.0) / (F.col("_P") * F.col("_N")),
        ).alias("auc"),
    )


# ------------------------------------------------------------------ M4, M6, M7
def fold_auc(oof: DataFrame) -> DataFrame:
    """M4: AUC per fold, then mean and population std."""
    per = auc_by_group(oof, ["fold"], "prob", LABEL, "CustomerID")
    return per.agg(F.avg("auc").alias("roc_auc_mean"), F.stddev_pop("auc").alias("roc_auc_std"))


def classification_metrics(pred: DataFrame, label_col: str = LABEL, pred_col: str = "prediction") -> DataFrame:
    """M6: precision, recall, F1 of the positive class; 0 where undefined."""
    y, p = F.col(label_col) == 1, F.col(pred_col) == 1
    c = pred.agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn")
    )
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn")), F.lit(0.0))
    return c.select(
        prec.alias("precision"),
        rec.alias("recall"),
        F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0)).alias("f1"),
    )


def confusion_matrix(pred: DataFrame, label_col: str = LABEL, pred_col: str = "prediction") -> DataFrame:
    """M7: 2x2 counts, rows = truth; absent cells are 0."""
    return pred.agg(
        *[
            F.count_if((F.col(label_col) == t) & (F.col(pred_col) == q)).alias(f"true{t}_pred{q}")
            for t in (0, 1)
            for q in (0, 1)
        ]
    )


# ------------------------------------------------------------------------- M9
def shuffle_keys(n: int, count: int, seed: int) -> list[tuple[int, int]]:
    """``count`` keyed bijections of 0..n-1: row p gives its value to row (a p + b) mod n, with a prime to n."""
    rnd = random.Random(seed)
    keys = []
    while len(keys) < count:
        a = rnd.randrange(1, max(n, 2))
        if math.gcd(a, n) == 1:
            keys.append((a, rnd.randrange(max(n, 1))))
    return keys


#: Consecutive row numbers whose rows meet in one group to be scored again.
_RESCORED_ROWS = 2048


def _send_values(model: BoostedTrees, keys: list[tuple[int, int]], n: int, label: str):
    """(numbered rows) batches to (block, at, slot, value): what each block of row numbers receives.

    Slots: a value (its bin) per key, then the row's own bins, then its label.
    """
    n_features = len(model.features)
    n_repeats, size = len(keys) // n_features, _RESCORED_ROWS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            bins, pos = model.bins(pdf), pdf["pos"].to_numpy(np.int64)
            sent = [((pos * a + b) % n, bins[:, k // n_repeats]) for k, (a, b) in enumerate(keys)]
            sent += [(pos, bins[:, f]) for f in range(n_features)]
            sent.append((pos, pdf[label].to_numpy(np.uint8)))
            to = np.concatenate([t for t, _ in sent])
            value = np.concatenate([v for _, v in sent])
            slot = np.repeat(np.arange(len(sent), dtype=np.uint16), len(pdf))
            order = np.argsort(to // size, kind="stable")
            to, value, slot = to[order], value[order], slot[order]
            at = (to % size).astype(np.uint16)
            block, first = np.unique(to // size, return_index=True)
            ends = [*first[1:], len(to)]
            parts = [[x[i:j].tobytes() for i, j in zip(first, ends, strict=True)] for x in (at, slot, value)]
            yield pd.DataFrame({"block": block, "at": parts[0], "slot": parts[1], "value": parts[2]})

    return run


def _rescore(model: BoostedTrees, n_repeats: int, n: int):
    """Probabilities of a block's rows: as they are, then with each feature replaced by each of its
    sent values. Trees that never test the replaced feature keep their sum, computed once per feature."""
    n_features = len(model.features)
    n_keys, size = n_features * n_repeats, _RESCORED_ROWS

    def run(table: pa.Table) -> pa.Table:
        here = min(size, n - table.column("block")[0].as_py() * size)
        got = np.empty((n_keys + n_features + 1, here), np.uint8)
        at, slot, value = (
            np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
            for c, kind in (("at", np.uint16), ("slot", np.uint16), ("value", np.uint8))
        )
        got[slot, at] = value
        bins, label = np.ascontiguousarray(got[n_keys:-1].T), got[-1].astype(np.int32)
        out = [_sigmoid(model.margins(bins))]
        for f in range(n_features):
            changed = np.tile(bins, (n_repeats, 1))
            changed[:, f] = got[f * n_repeats : (f + 1) * n_repeats].ravel()
            margin = model.margins(changed, only=f).reshape(n_repeats, here) + model.margins(bins, without=f)
            out += list(_sigmoid(margin))
        k = np.repeat(np.arange(len(out), dtype=np.int32), here)
        return pa.table({"k": k, "prob": np.concatenate(out), "label": np.tile(label, len(out))})

    return run


def permutation_importance(model: BoostedTrees, holdout: DataFrame, params: AnalysisParams) -> DataFrame:
    """M9: mean / std (population) AUC drop when one feature is shuffled, per feature.

    Rows are numbered once in a seeded hash order. For each (feature, repeat) a keyed
    bijection of those numbers says which row receives whose value, so a shuffle is
    arithmetic, without a sort or a copy: a row sends out its values' bins, a byte each, and
    what a block of row numbers receives meets in one group of fixed size, however many rows there
    are. Every row is used in every repeat; a row's trees are walked again only where they test
    the shuffled feature.
    """
    feats = list(params.ltv_features)
    rows = global_rank(
        holdout.withColumn("_h", F.xxhash64("CustomerID", F.lit(params.seed))), ["_h", "CustomerID"], "pos"
    ).select(
        F.col(LABEL).cast("int").alias(LABEL), *[F.col(c).cast("double").alias(c) for c in feats], (F.col("pos") - 1).alias("pos")
    )
    n = rows.count()
    keys = shuffle_keys(n, len(feats) * params.n_repeats, params.seed)
    sent = rows.mapInPandas(_send_values(model, keys, n, LABEL), "block long, at binary, slot binary, value binary")
    scored = (
        sent.groupBy("block")
        .applyInArrow(_rescore(model, params.n_repeats, n), "k int, prob double, label int")
        .select(
            F.floor((F.col("k") - 1) / params.n_repeats).cast("int").alias("feature_idx"),  # -1: as it is
            F.when(F.col("k") > 0, (F.col("k") - 1) % params.n_repeats).otherwise(-1).alias("repeat"),
            F.col("label").alias(LABEL),
            "prob",
        )
    )
    aucs = reliable_checkpoint(auc_by_group(scored, ["feature_idx", "repeat"], "prob", LABEL))
    # the unpermuted AUC is one number: read it once instead of joining a one-row frame
    base = aucs.where(F.col("feature_idx") == -1).first()
    drop = F.lit(base["auc"] if base else None).cast("double") - F.col("auc")
    names = F.array(*[F.lit(c) for c in feats])
    return (
        aucs.where(F.col("feature_idx") >= 0)
        .groupBy("feature_idx")
        .agg(F.avg(drop).alias("importance"), F.stddev_pop(drop).alias("std"))
        .select(F.element_at(names, F.col("feature_idx") + 1).alias("feature"), "importance", "std")
        .orderBy(F.desc("importance"), "feature")
    )


# ------------------------------------------------------------------------ M10
def top_features(importance: DataFrame, params: AnalysisParams) -> tuple[list[dict], list[str]]:
    """Top 3 features and the top 2 outside Recency / Frequency (bounded collect)."""
    rows = importance.orderBy(F.desc("importance"), "feature").collect()
    top3 = [{"name": r["feature"], "importance": float(r["importance"])} for r in rows[:3]]
    non_rfm = [r["feature"] for r in rows if r["feature"] not in params.rfm_features][:2]
    return top3, non_rfm


# ------------------------------------------------------------------------ M11
def dependence_grid(train: DataFrame, feature: str, params: AnalysisParams) -> list[float]:
    """The distinct values if there are fewer than the grid has points, else an even grid
    between the exact (interpolated) outer percentiles."""
    n = params.pd_grid_resolution
    distinct = train.select(feature).where(F.col(feature).isNotNull()).distinct().limit(n).collect()  # at most n
    if len(distinct) < n:
        return sorted(float(r[0]) for r in distinct)
    lo, hi = interpolated_quantiles(train, feature, params.pd_percentiles)
    return [lo + (hi - lo) * i / (n - 1) for i in range(n)]


def partial_dependence(model: BoostedTrees, train: DataFrame, feature: str, params: AnalysisParams) -> DataFrame:
    """Mean predicted probability over the training rows with ``feature`` set to each grid value.

    Grid values between the same two cuts of the model share one score, and between the same
    two cuts of a tree that tree's value: a row walks a tree once per interval of the tree
    that the grid meets, and trees that never test the feature once. Every task sends one sum
    per interval.
    """
    grid = dependence_grid(train, feature, params)
    f = model.features.index(feature)
    at = to_bins(np.array(grid, np.float64).reshape(-1, 1), [model.thresholds[f]])[:, 0].astype(np.int64)
    interval = np.searchsorted(model.cuts(f), at, side="left")
    met = {int(k): int(b) for k, b in zip(interval, at, strict=True)}  # any bin of the interval

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, n = dict.fromkeys(met, 0.0), 0
        for pdf in batches:
            bins = model.bins(pdf)
            n += len(bins)
            margin = dict.fromkeys(met, model.margins(bins, without=f))
            for tree in model.trees:
                if f in tree.tested():
                    values = {}
                    for k, b in met.items():
                        own = int(np.searchsorted(tree.cuts(f), b, side="left"))
                        if own not in values:
                            bins[:, f] = b
                            values[own] = tree.values(bins)
                        margin[k] = margin[k] + values[own]
            for k, m in margin.items():
                total[k] += float(_sigmoid(m).sum())
        yield pd.DataFrame({"interval": list(total), "total": list(total.values()), "n": n})

    sums = (
        train.select(*[F.col(c).cast("double").alias(c) for c in model.features])
        .mapInPandas(run, "interval long, total double, n long")
        .groupBy("interval")
        .agg(F.try_divide(F.sum("total"), F.sum("n")).alias("mean_probability"))
    )
    # at most one row per grid value
    points = train.sparkSession.createDataFrame(
        [(float(g), int(k)) for g, k in zip(grid, interval, strict=True)], "grid_value double, at long"
    )
    return (
        sums.join(F.broadcast(points), F.col("interval") == F.col("at"))
        .select("grid_value", "mean_probability", F.lit(feature).alias("feature"))
        .orderBy("grid_value")
    )


# ---------------------------------------------------------------- whole study
class LtvStudy:
    """M1-M11 over the scored customers; each part is computed on first use only (the
    models with the first part that needs one)."""

    def __init__(self, scored: DataFrame, params: AnalysisParams):
        self.scored = scored
        self.params = params

    @cached_property
    def threshold(self) -> float | None:
        return high_value_threshold(self.scored, self.params)

    @cached_property
    def frame(self) -> DataFrame:
        return model_frame(self.scored, self.params, self.threshold)

    @cached_property
    def assigned(self) -> DataFrame:
        return reliable_checkpoint(folds_and_holdout(self.frame, self.params))

    @cached_property
    def fitted(self) -> StudyFit:
        return StudyFit(self.assigned, self.params)

    @cached_property
    def oof(self) -> DataFrame:
        return reliable_checkpoint(self.fitted.out_of_fold())

    @property
    def auc(self) -> DataFrame:
        return fold_auc(self.oof)

    @property
    def metrics(self) -> DataFrame:
        return classification_metrics(self.oof)

    @property
    def confusion(self) -> DataFrame:
        return confusion_matrix(self.oof)

    def _rows(self, held: bool) -> DataFrame:
        return self.assigned.where(F.col("held") if held else ~F.col("held")).drop("fold", "held")

    @property
    def holdout_model(self) -> BoostedTrees:
        return self.fitted.holdout_model

    @cached_property
    def importance(self) -> DataFrame:
        return reliable_checkpoint(permutation_importance(self.holdout_model, self._rows(True), self.params))

    @cached_property
    def _top(self) -> tuple[list, list]:
        return top_features(self.importance, self.params)

    @property
    def top3(self) -> list:
        return self._top[0]

    @property
    def top2_non_rfm(self) -> list:
        return self._top[1]

    @cached_property
    def pd(self) -> dict[str, DataFrame]:
        return {f: partial_dependence(self.holdout_model, self._rows(False), f, self.params) for f in self.top2_non_rfm}

    def summary(self) -> dict:
        a = self.auc.first()
        m = self.metrics.first()
        c = self.confusion.first()
        return {
            "model": "histogram gradient boosting",
            "target": "top quintile of customer net Monetary",
            "target_threshold_gbp": None if self.threshold is None else round(self.threshold, 2),
            "cv": f"{self.params.n_folds}-fold stratified, seed {self.params.seed}",
            "roc_auc_mean": round(float(a["roc_auc_mean"]), 4),
            "roc_auc_std": round(float(a["roc_auc_std"]), 4),
            "precision": round(float(m["precision"]), 4),
            "recall": round(float(m["recall"]), 4),
            "f1": round(float(m["f1"]), 4),
            "confusion_matrix": [
                [int(c["true0_pred0"]), int(c["true0_pred1"])],
                [int(c["true1_pred0"]), int(c["true1_pred1"])],
            ],
            "top_3_features": [{"name": t["name"], "importance": round(t["importance"], 5)} for t in self.top3],
            "top_2_non_rfm_features": list(self.top2_non_rfm),
        }


def ltv_study(scored: DataFrame, params: AnalysisParams) -> LtvStudy:
    return LtvStudy(scored, params)
