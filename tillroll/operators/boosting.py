"""Gradient boosting on histograms, grown leaf by leaf, several models in one pass.

Features are cut into at most ``max_bins`` bins at exact quantiles (midpoints between the
neighbouring values; every distinct value if there are fewer) and packed, a block of
customers per row, with one byte per feature, spread over the cores. A round is one DataFrame
job: every task adds up counts, gradients and hessians per (model, leaf, feature, bin)
over its blocks, the sums of a (model, leaf) meet in one group, dealt by the work it has, and
the group answers with its best split. The driver reads the splits only.
Gradients are whole multiples of 2^-30, so the sums, and with them the trees, do not depend on
the order of the rows.

Trees grow best first: the leaf with the largest gain is split next, until ``max_leaves``.
The choice needs the gains of all present leaves, so a round asks for the children of every
leaf that would be split with what is known; a leaf expanded in vain is dropped again. The rows
of a child of at most ``local_rows`` rows (a byte per feature, gradient, hessian) meet in one
group, which grows the subtree below it, as far as the tree could still take it, and answers with
the splits. The sums are the same whole numbers either way, so the bound decides on the number of
rounds, not on the trees.

An asked node is cut on by guesses: as the last tree cut the same region, else as its parent's
sums suggest. The tasks add up the sums of the guessed pieces, each row once, and the group puts
them together again: as far as a guess is the best split found, the nodes below it are answered
in the same round; a wrong guess is of no consequence.

All models of a study (one per fold, one for the hold-out split) share the blocks and the
rounds: a row carries a bit per model that trains on it and one margin per model. Once all models
have grown a tree, the margins are brought up to date in a persisted frame of blocks; every few
trees the blocks are written anew to the shared checkpoint folder, so a lost executor costs the
margins of these few trees. When all trees are grown, the margins of the rows that a model did
not train on are its out-of-fold predictions, without another pass over a model.

With more than ``early_stopping_rows`` training rows a tenth of them (by a hash of the id) is
kept for validation, and a model stops when ten trees have not lowered its loss.

A missing value has a bin of its own, sent to the side where it gains more.
"""

from __future__ import annotations

import heapq
import sys
import uuid
from collections.abc import Callable, Collection, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..params import AnalysisParams
from ..session import ensure_checkpoint_dir, reliable_checkpoint, remove_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors do not need this package

MISSING = 255  # the bin of null and NaN
_BINS = 256
_ONE = 1 << 30  # gradients and hessians are counted in units of 1 / _ONE
_LOSS = 4095  # the slot that carries a model's validation loss
_MIN_HESSIAN = 1e-3
_SLOTS = 4096  # of a model's keys in a round: its nodes by place, and the loss
_TASK_ROWS = 4_000, 250_000  # a task has so many rows before there are more, and at most about so many
_BLOCK_ROWS = 1 << 15  # customers in a block; their sums stay far below 2^53


# --------------------------------------------------------------------------------- bins
def bin_thresholds(frame: DataFrame, features: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Ascending thresholds per feature; a value's bin is the number of thresholds below it.

    One pass for all features: rows per (feature, value), ranged over partitions and summed
    there, with one offset per partition and feature. Only the values at quantile positions
    (all values of a feature with few) reach the driver, at most 2 x max_bins per feature.
    """
    values = F.array(*[F.struct(F.lit(k).alias("f"), F.col(c).cast("double").alias("v")) for k, c in enumerate(features)])
    counts = (
        frame.select(F.inline(values))
        .where("v IS NOT NULL AND NOT isnan(v)")
        .groupBy("f", "v")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    placed = reliable_checkpoint(counts.orderBy("f", "v").select("*", F.spark_partition_id().alias("part")))
    sizes = placed.groupBy("part", "f").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("distinct"))
    sizes = sizes.toPandas().sort_values(["f", "part"])  # one row per partition and feature
    total = sizes.groupby("f")[["rows", "distinct"]].sum()
    sizes["offset"] = sizes.groupby("f")["rows"].cumsum() - sizes["rows"]
    wanted = {}
    for f, (rows, distinct) in total.iterrows():
        if distinct > max_bins:
            at = np.arange(1, max_bins) * (rows - 1) / max_bins
            wanted[int(f)] = at
    spark = frame.sparkSession
    offsets = spark.createDataFrame(
        [(int(r.f), int(r.part), int(r.offset)) for r in sizes.itertuples()], "f0 int, part0 int, offset long"
    )
    positions = {
        f: sorted({int(x) for x in np.floor(at)} | {int(x) for x in np.ceil(at)}) for f, at in wanted.items()
    }
    asked = F.lit(True)
    upto = F.col("offset") + F.sum("n").over(Window.partitionBy("f", "part").orderBy("v"))
    for f, ps in positions.items():
        covers = F.exists(F.array(*[F.lit(p).cast("long") for p in ps]), lambda p: (p < F.col("upto")) & (p >= F.col("upto") - F.col("n")))
        asked = F.when(F.col("f") == f, covers).otherwise(asked)
    found = (
        placed.join(F.broadcast(offsets), (F.col("f") == F.col("f0")) & (F.col("part") == F.col("part0")))
        .withColumn("upto", upto)
        .where(asked)
        .select("f", "v", "n", "upto")
        .toPandas()
        .sort_values(["f", "v"])
    )
    out = []
    for f in range(len(features)):
        mine = found[found["f"] == f]
        v = mine["v"].to_numpy()
        if f in wanted:
            value_at = lambda p: v[np.searchsorted(mine["upto"].to_numpy(), p, side="right")]  # noqa: B023, E731
            at = wanted[f]
            out.append(np.unique((value_at(np.floor(at)) + value_at(np.ceil(at))) / 2))
        else:
            out.append((v[1:] + v[:-1]) / 2)
    return out


def to_bins(values: np.ndarray, thresholds: Sequence[np.ndarray]) -> np.ndarray:
    """Bins (rows x features, one byte each) of a matrix of values."""
    out = np.empty(values.shape, np.uint8)
    for f, edges in enumerate(thresholds):
        out[:, f] = np.searchsorted(edges, values[:, f], side="left")
        out[np.isnan(values[:, f]), f] = MISSING
    return out


# -------------------------------------------------------------------------------- trees
@dataclass
class Tree:
    """Nodes as parallel lists; a node without children has left = -1 and a value."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self) -> int:
        for column, x in (
            (self.feature, 0), (self.bin, 0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, 0.0)
        ):
            column.append(x)
        return len(self.left) - 1

    def spread(self, bins: np.ndarray, rows: np.ndarray, ends: Collection[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(node, its rows) for the leaves, or for the nodes ``ends`` only; nodes without rows are left out."""
        through = None if ends is None else self._above(ends)
        open_nodes = [(0, rows)]
        while open_nodes:
            node, rows = open_nodes.pop()
            if not len(rows):
                continue
            if self.left[node] < 0 if ends is None else node in ends:
                yield node, rows
            elif through is None or node in through:
                b = bins[:, self.feature[node]][rows]
                goes_left = b <= self.bin[node]
                if self.missing_left[node]:
                    goes_left |= b == MISSING
                open_nodes += [(self.left[node], rows[goes_left]), (self.right[node], rows[~goes_left])]

    def _above(self, ends: Collection[int]) -> set[int]:
        """The nodes on the ways to ``ends``; children have larger numbers than their parent."""
        out = set(ends)
        for node in range(len(self.left) - 1, -1, -1):
            if self.left[node] >= 0 and (self.left[node] in out or self.right[node] in out):
                out.add(node)
        return out

    def values(self, bins: np.ndarray) -> np.ndarray:
        out = np.empty(len(bins))
        for node, rows in self.spread(bins, np.arange(len(bins))):
            out[rows] = self.value[node]
        return out

    def cuts(self, feature: int) -> np.ndarray:
        """The bins at which the tree cuts the feature, ascending."""
        found = {b for f, b, k in zip(self.feature, self.bin, self.left, strict=True) if k >= 0 and f == feature}
        return np.array(sorted(found), np.int64)

    def tested(self) -> set[int]:
        return {f for f, k in zip(self.feature, self.left, strict=True) if k >= 0}


Cut = tuple[int, int, bool]  # feature, bin, missing_left
Region = dict[int, tuple[int, int, bool]]  # by feature: above which bin, up to which, missing values too


def _part(region: Region, cut: Cut, low: bool) -> Region:
    feature, b, missing_left = cut
    above, upto, missing = region.get(feature, (-1, MISSING, True))
    side = (above, min(upto, b), missing and missing_left) if low else (max(above, b), upto, missing and not missing_left)
    return {**region, feature: side}


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    bin: int
    missing_left: bool
    left: tuple[int, int, int]  # rows, gradients, hessians

    @property
    def cut(self) -> Cut:
        return self.feature, self.bin, self.missing_left


def best_split(hist: np.ndarray, min_rows: int, l2: float) -> Split | None:
    """The split of largest gain of a (feature, bin, 3) histogram; the first of equals."""
    total = hist[0].sum(0)
    cut = hist[:, :MISSING].cumsum(1)
    missing = hist[:, MISSING:]
    best = None
    for missing_left, left in ((False, cut), (True, cut + missing)):
        right = total - left
        g, h = left[..., 1] / _ONE, left[..., 2] / _ONE
        gr, hr = right[..., 1] / _ONE, right[..., 2] / _ONE
        ok = (left[..., 0] >= min_rows) & (right[..., 0] >= min_rows) & (h >= _MIN_HESSIAN) & (hr >= _MIN_HESSIAN)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = g * g / (h + l2) + gr * gr / (hr + l2)
        gain = np.where(ok, gain - (total[1] / _ONE) ** 2 / max(total[2] / _ONE + l2, 1e-300), 0.0)
        k = int(gain.argmax())
        f, b = divmod(k, gain.shape[1])
        if gain[f, b] > (best.gain if best else 1e-12):
            best = Split(float(gain[f, b]), f, b, missing_left, tuple(int(x) for x in left[f, b]))
        if not missing.any():
            break
    return best


def histogram(bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """(feature, bin, 3) sums of rows that are at hand; ``g`` and ``h`` are whole numbers."""
    return histograms(bins, g, h, [len(bins)])[0]


def likely_split(hist: np.ndarray, split: Split, low: bool, min_rows: int, l2: float) -> Split | None:
    """A guess of a child's best split from its parent's sums: the cut feature's bins are the child's
    own, of the other features each bin loses rows, gradients and hessians in proportion to its rows."""
    total = hist[0].sum(0)
    left = np.array(split.left)
    gone = total - left if low else left
    child = np.rint(hist - hist[..., :1] / total[0] * gone)
    mine = (np.arange(_BINS) <= split.bin) == low
    mine[MISSING] = split.missing_left == low
    child[split.feature] = np.where(mine[:, None], hist[split.feature], 0)
    return best_split(child, min_rows, l2)


def histograms(bins: np.ndarray, g: np.ndarray, h: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """(cell, feature, bin, 3) sums of rows that lie cell by cell, so many of each."""
    out = np.empty((len(sizes), bins.shape[1], _BINS, 3), np.int64)
    first = np.repeat(np.arange(len(sizes)) * _BINS, sizes)
    for f in range(bins.shape[1]):
        at = first + bins[:, f]
        for c, weights in enumerate((None, g, h)):
            out[:, f, :, c] = np.bincount(at, weights, len(sizes) * _BINS).reshape(-1, _BINS)  # far below 2^53: exact
    return out


@dataclass
class Found:
    """What a round answers of one node: its sums, its best split and, if its rows were at hand or
    its split was guessed, the nodes below it (``low`` and ``high`` are both set or both not)."""

    sums: tuple[int, int, int]  # rows, gradients, hessians
    split: Split | None
    low: Found | None = None
    high: Found | None = None
    guesses: tuple[Cut | None, Cut | None] = None, None  # of the splits of its two children


def grow_from_rows(bins: np.ndarray, g: np.ndarray, h: np.ndarray, splits: int, min_rows: int, l2: float) -> Found:
    """A node grown best first from its rows, by at most ``splits`` splits."""

    def found(hist: np.ndarray, rows: np.ndarray, path: str) -> Found:
        node = Found(tuple(int(x) for x in hist[0].sum(0)), best_split(hist, min_rows, l2))
        if node.split:
            heapq.heappush(queue, (-node.split.gain, path, node, hist, rows))
        return node

    queue: list[tuple] = []
    root = found(histogram(bins, g, h), np.arange(len(bins)), "")
    while queue and splits > 0:
        _, path, node, whole, rows = heapq.heappop(queue)
        splits -= 1
        b = bins[rows, node.split.feature]
        left = np.where(b == MISSING, node.split.missing_left, b <= node.split.bin)
        sides = [rows[left], rows[~left]]
        if not splits:  # nothing is split below
            n = node.split.left
            node.low, node.high = Found(n, None), Found(tuple(a - b for a, b in zip(node.sums, n, strict=True)), None)
            break
        small = int(len(sides[1]) < len(sides[0]))
        hists = [None, None]
        hists[small] = histogram(bins[sides[small]], g[sides[small]], h[sides[small]])
        hists[1 - small] = whole - hists[small]
        node.low, node.high = (found(hists[k], sides[k], path + "01"[k]) for k in (0, 1))
    return root


class GrowingTree:
    """One tree under best-first growth.

    ``asked`` are the nodes whose best splits the next round finds, ``wanted`` those below which it
    grows the tree from their rows, each with the number of splits that it can still be given.
    """

    def __init__(self, max_leaves: int, min_rows: int, l2: float, n_rows: int, local_rows: int):
        self.max_leaves, self.min_rows, self.l2, self.local_rows = max_leaves, min_rows, l2, local_rows
        self.tree = Tree()
        self.sums: dict[int, tuple[int, int, int]] = {}
        self.split: dict[int, Split | None] = {}
        self.guess: dict[int, Cut] = {}  # of the splits of nodes that are not known yet
        self.guesses: dict[int, tuple[Cut | None, Cut | None]] = {}  # by parent
        self.path: dict[int, str] = {}  # orders equal gains, however the nodes came
        root = self.tree.add()
        self.path[root] = ""
        self.asked: list[int] = [root] if n_rows > local_rows else []
        self.wanted: dict[int, int] = {} if self.asked else {root: max_leaves - 1}
        self.starts = True
        self.kept: set[int] | None = None  # the nodes that are split, once the tree is grown

    def receive(self, found: dict[int, Found]) -> None:
        """What was asked for, by node."""
        for node, answer in found.items():
            self._know(node, answer)
        self.asked, self.wanted, self.starts = [], {}, False
        self._choose()

    def _know(self, node: int, found: Found) -> None:
        self.sums[node], self.split[node], self.guesses[node] = found.sums, found.split, found.guesses
        if found.low:
            for child, below in zip(self._branch(node), (found.low, found.high), strict=True):
                self._know(child, below)

    def _branch(self, node: int) -> tuple[int, int]:
        split, t = self.split[node], self.tree
        t.feature[node], t.bin[node], t.missing_left[node] = split.feature, split.bin, split.missing_left
        low, high = t.add(), t.add()
        t.left[node], t.right[node] = low, high
        self.sums[low] = split.left
        self.sums[high] = tuple(a - b for a, b in zip(self.sums[node], split.left, strict=True))
        self.path.update({low: self.path[node] + "0", high: self.path[node] + "1"})
        return low, high

    def _choose(self) -> None:
        """Split best first with what is known; ask for the children of leaves split on the way."""
        while True:
            leaves, kept, unknown = 1, set(), []
            queue = [(-self.split[0].gain, "", 0)] if self.split[0] else []
            while queue and leaves < self.max_leaves:
                _, _, node = heapq.heappop(queue)
                kept.add(node)
                leaves += 1
                if self.tree.left[node] < 0:
                    # whatever else comes to be known, these splits stay before those below the node
                    unknown.append((node, self.max_leaves - leaves))
                    continue
                for child in (self.tree.left[node], self.tree.right[node]):
                    if self.split.get(child):
                        heapq.heappush(queue, (-self.split[child].gain, self.path[child], child))
            if not unknown:
                self.kept = kept
                return
            for node, splits in unknown:
                self._expand(node, splits)
            if self.asked or self.wanted:
                return

    def _expand(self, node: int, splits: int) -> None:
        for child, guess in zip(self._branch(node), self.guesses[node], strict=True):
            n = self.sums[child][0]
            if not splits or n < 2 * self.min_rows:
                self.split[child] = None
            elif n <= self.local_rows:
                self.wanted[child] = splits
            else:
                self.asked.append(child)
                if guess:
                    self.guess[child] = guess

    def _cut(self, node: int) -> Cut:
        return self.tree.feature[node], self.tree.bin[node], self.tree.missing_left[node]

    def remember(self, seen: dict[frozenset, Cut]) -> None:
        """Notes how the regions of more than ``local_rows`` rows were cut."""
        open_nodes: list[tuple[int, Region]] = [(0, {})]
        while open_nodes:
            node, region = open_nodes.pop()
            if node in self.kept and self.sums[node][0] > self.local_rows:
                cut = seen[frozenset(region.items())] = self._cut(node)
                open_nodes += [(self.tree.left[node], _part(region, cut, True)), (self.tree.right[node], _part(region, cut, False))]

    def with_guesses(self, seen: dict[frozenset, Cut]) -> Tree:
        """A copy of the tree in which the asked nodes are cut on as the last tree cut the same region, or
        else as their parent's sums suggest; nodes nearer to the asked ones first, by less than
        ``max_leaves`` cuts in all."""
        t = self.tree
        out = Tree(*(list(column) for column in (t.feature, t.bin, t.missing_left, t.left, t.right, t.value)))
        asked, guessed = set(self.asked), []
        open_nodes: list[tuple[int, Region]] = [(0, {})]
        while open_nodes:
            node, region = open_nodes.pop()
            if node in asked:
                guessed.append((node, region))
            elif t.left[node] >= 0:
                cut = self._cut(node)
                open_nodes += [(t.left[node], _part(region, cut, True)), (t.right[node], _part(region, cut, False))]
        cuts = 0
        for node, region in guessed:  # grows on the way
            cut = seen.get(frozenset(region.items())) or (self.guess.get(node) if node in asked else None)
            if cut and cuts < self.max_leaves - 1:
                cuts += 1
                out.feature[node], out.bin[node], out.missing_left[node] = cut
                out.left[node], out.right[node] = out.add(), out.add()
                guessed += [(out.left[node], _part(region, cut, True)), (out.right[node], _part(region, cut, False))]
        return out

    def grown(self, rate: float) -> Tree:
        """The tree without the expansions that were not chosen, with leaf values."""
        out = Tree()

        def copy(node: int) -> int:
            at = out.add()
            if node in self.kept:
                for name in ("feature", "bin", "missing_left"):
                    getattr(out, name)[at] = getattr(self.tree, name)[node]
                out.left[at] = copy(self.tree.left[node])
                out.right[at] = copy(self.tree.right[node])
            else:
                _, g, h = self.sums[node]
                out.value[at] = -rate * (g / _ONE) / (h / _ONE + self.l2 + 1e-15)
            return at

        copy(0)
        return out


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class BoostedTrees:
    """A fitted model: margin = baseline + sum of the trees' values at the row's bins."""

    features: tuple[str, ...]
    thresholds: list[np.ndarray]
    baseline: float
    trees: list[Tree] = field(default_factory=list)

    def bins(self, pdf: pd.DataFrame) -> np.ndarray:
        values = np.column_stack([pdf[c].to_numpy(np.float64, na_value=np.nan) for c in self.features])
        return to_bins(values, self.thresholds)

    def margins(self, bins: np.ndarray, without: int | None = None, only: int | None = None) -> np.ndarray:
        """Sum over the trees; over those that do not test, or only those that test, a feature."""
        out = np.full(len(bins), 0.0 if only is not None else self.baseline)
        for t in self.trees:
            tests = t.tested()
            if (without is None or without not in tests) and (only is None or only in tests):
                out += t.values(bins)
        return out

    def cuts(self, feature: int) -> np.ndarray:
        """The bins at which some tree cuts the feature, ascending."""
        return np.unique(np.concatenate([np.empty(0, np.int64), *(t.cuts(feature) for t in self.trees)]))

    def predict(self, df: DataFrame, threshold: float = 0.5) -> DataFrame:
        """``df`` with ``prob`` and ``prediction``."""
        shared = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def prob(parts: pd.DataFrame) -> pd.Series:
            model = shared.value
            return pd.Series(_sigmoid(model.margins(model.bins(parts))))

        scored = df.withColumn("prob", prob(F.struct(*[F.col(c).cast("double").alias(c) for c in self.features])))
        return scored.withColumn("prediction", (F.col("prob") > threshold).cast("int"))


# ------------------------------------------------------------------------------- blocks
_PARTS = "id", "bins", "label", "member", "valid"


def _margins(n_models: int) -> list[str]:
    """A column per model: a round reads those of the models that still grow a tree."""
    return [f"margin{m}" for m in range(n_models)]


def _block_schema(n_models: int) -> pa.Schema:
    return pa.schema([("n", pa.int64())] + [(c, pa.binary()) for c in (*_PARTS, *_margins(n_models))])


def _block_ddl(n_models: int) -> str:
    return ", ".join(["n long", *(f"{c} binary" for c in (*_PARTS, *_margins(n_models)))])


def _bits(n_models: int) -> type:
    """A bit per model."""
    return np.uint8 if n_models <= 8 else np.int64


def _pack(thresholds: list[np.ndarray], n_models: int, baselines: np.ndarray):
    """(id, label, member, valid, features...) batches to blocks."""
    schema = _block_schema(n_models)

    def block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        pdf = pa.Table.from_batches(batches).to_pandas()
        values = np.column_stack([pdf[c].to_numpy(np.float64, na_value=np.nan) for c in pdf.columns[4:]])
        parts = [
            pdf["id"].to_numpy(np.int64),
            to_bins(values, thresholds),
            pdf["label"].to_numpy(np.uint8),
            *(pdf[c].to_numpy(np.int64).astype(_bits(n_models)) for c in ("member", "valid")),
            *(np.full(len(pdf), b) for b in baselines),
        ]
        arrays = [pa.array([len(pdf)], pa.int64()), *(pa.array([p.tobytes()], pa.binary()) for p in parts)]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for start in range(0, batch.num_rows, _BLOCK_ROWS):
                part = batch.slice(start, _BLOCK_ROWS)
                if held and n + part.num_rows > _BLOCK_ROWS:
                    yield block(held)
                    held, n = [], 0
                held.append(part)
                n += part.num_rows
        if held:
            yield block(held)

    return run


class _Block:
    """A row of the blocks; a round does not read all of its columns."""

    def __init__(self, row: dict, n_features: int, n_models: int):
        self.row, self.n = row, row["n"]
        bits = _bits(n_models)
        kinds = {"id": np.int64, "bins": np.uint8, "label": np.uint8, "member": bits, "valid": bits}
        read = {c: np.frombuffer(row[c], kind) for c, kind in kinds.items() if c in row}
        self.id, self.label, self.member, self.valid = (read.get(c) for c in ("id", "label", "member", "valid"))
        self.bins = read["bins"].reshape(self.n, n_features)

    def margin(self, model: int) -> np.ndarray:
        return np.frombuffer(self.row[f"margin{model}"], np.float64)


def _blocks(batches: Iterator[pa.RecordBatch], n_features: int, n_models: int) -> Iterator[_Block]:
    for batch in batches:
        for row in batch.to_pylist():
            yield _Block(row, n_features, n_models)


@dataclass(frozen=True)
class _Task:
    """What a round asks of one model: the growing tree with its guesses, the nodes whose sums are counted,
    those whose rows are read (with the splits that they may be given), and whether the validation loss is due."""

    model: int
    growing: Tree
    asked: tuple[int, ...]
    wanted: tuple[tuple[int, int], ...]
    with_loss: bool

    @property
    def nodes(self) -> tuple[int, ...]:
        """By place in the keys of the round."""
        return (*self.asked, *(node for node, _ in self.wanted))

    def ends(self) -> dict[int, int]:
        """The place by node: a node whose rows are read, or one at the end of an asked node's guesses."""
        t, out, open_nodes = self.growing, {}, list(enumerate(self.nodes))
        while open_nodes:
            place, node = open_nodes.pop()
            if t.left[node] < 0:
                out[node] = place
            else:
                open_nodes += [(place, t.left[node]), (place, t.right[node])]
        return out


    def training(self, block: _Block) -> np.ndarray:
        return np.flatnonzero((block.member & ~block.valid & (1 << self.model)) != 0)

    def weights(self, block: _Block, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients and hessians, whole numbers of at most 2^30."""
        p = _sigmoid(block.margin(self.model)[rows])
        return np.rint((p - block.label[rows]) * _ONE), np.rint(p * (1 - p) * _ONE)

    def loss(self, block: _Block) -> np.ndarray:
        """(rows, loss) of the block's validation rows."""
        held = np.flatnonzero((block.member & block.valid & (1 << self.model)) != 0)
        margin = block.margin(self.model)[held]
        each = np.logaddexp(0, margin) - block.label[held] * margin
        return np.array([len(held), np.rint(each * _ONE).sum()], np.int64)


# the sums of an end over a task's blocks, of a read node its rows of a block; dealt by ``task``
_SENT = pa.schema(
    [("task", pa.int32()), ("key", pa.int64()), ("node", pa.int32())] + [(c, pa.binary()) for c in ("sums", "bins", "g", "h")]
)
_SENT_DDL = "task int, key long, node int, sums binary, bins binary, g binary, h binary"


def _send(tasks: Sequence[_Task], n_features: int, n_models: int, dealt: dict[int, int]) -> Callable:
    """Per partition: the sums of the asked nodes, the rows of the read nodes and the losses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        ends = [task.ends() for task in tasks]
        for block in _blocks(batches, n_features, n_models):
            read = []
            for task, places in zip(tasks, ends, strict=True):
                first, cells = task.model * _SLOTS, []
                for node, rows in task.growing.spread(block.bins, task.training(block), places):
                    if places[node] < len(task.asked):
                        cells.append((node, rows))
                    else:
                        key, sent = first + places[node], [x.astype(np.int32) for x in task.weights(block, rows)]
                        read.append((dealt[key], key, node, None, *(x.tobytes() for x in (block.bins[rows], *sent))))
                if cells:
                    rows = np.concatenate([rows for _, rows in cells])
                    counted = histograms(block.bins[rows], *task.weights(block, rows), [len(rows) for _, rows in cells])
                    for (node, _), mine in zip(cells, counted, strict=True):
                        at = first + places[node], node
                        sums[at] = sums[at] + mine if at in sums else mine
                loss = task.loss(block) if task.with_loss else (0, 0)
                if loss[0]:
                    sums[first + _LOSS, 0] = sums.get((first + _LOSS, 0), 0) + loss
            if read:
                yield _sent(read)
        if sums:
            yield _sent([(dealt[key], key, node, x.tobytes(), None, None, None) for (key, node), x in sums.items()])

    def _sent(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(_SENT.types)], schema=_SENT)

    return run


def _summed(table: pa.Table) -> np.ndarray:
    """The sums of a counted node over all tasks."""
    return sum(np.frombuffer(x, np.int64) for x in table.column("sums").to_pylist())


_CUT = "feature", "bin", "missing_left"
_FOUND = pa.schema(
    [("key", pa.int64()), ("node", pa.int32()), ("below", pa.int32())]
    + [(c, pa.int64()) for c in ("n", "g", "h")]
    + [("gain", pa.float64()), ("feature", pa.int32()), ("bin", pa.int32()), ("missing_left", pa.bool_())]
    + [(c, pa.int64()) for c in ("left_n", "left_g", "left_h")]
    + [(f"{c}_{side}", kind) for side in ("low", "high") for c, kind in zip(_CUT, (pa.int32(), pa.int32(), pa.bool_()), strict=True)]
)
_FOUND_DDL = (
    "key long, node int, below int, n long, g long, h long, gain double, feature int, bin int, "
    "missing_left boolean, left_n long, left_g long, left_h long, "
    "feature_low int, bin_low int, missing_left_low boolean, feature_high int, bin_high int, missing_left_high boolean"
)


def _find(tasks: Sequence[_Task], n_features: int, min_rows: int, l2: float, local_rows: int) -> Callable:
    """Per key: the node and the nodes known below it (``below`` is the first of a node's two, which
    stand side by side), each with its sums and its best split; a loss is a node without a split."""
    of = {t.model: t for t in tasks}

    def counted(task: _Task, root: int, sums: dict[int, np.ndarray]) -> Found:
        """The asked node, and the nodes below it as far as its guesses are its best splits."""
        t, hists = task.growing, {}

        def add_up(node: int) -> np.ndarray:
            if t.left[node] < 0:
                hist = sums[node].reshape(n_features, _BINS, 3) if node in sums else np.zeros((n_features, _BINS, 3), np.int64)
            else:
                hist = add_up(t.left[node]) + add_up(t.right[node])
            hists[node] = hist
            return hist

        def found(node: int) -> Found:
            s = best_split(hists[node], min_rows, l2)
            out = Found(tuple(hists[node][0].sum(0).tolist()), s)
            if s and t.left[node] >= 0 and s.cut == (t.feature[node], t.bin[node], t.missing_left[node]):
                out.low, out.high = found(t.left[node]), found(t.right[node])
            elif s:
                out.guesses = guess(hists[node], out, True), guess(hists[node], out, False)
            return out

        def guess(hist: np.ndarray, x: Found, low: bool) -> Cut | None:
            if (x.split.left[0] if low else x.sums[0] - x.split.left[0]) <= local_rows:
                return None
            s = likely_split(hist, x.split, low, min_rows, l2)
            return s.cut if s else None

        add_up(root)
        return found(root)

    def find(key: int, sums: dict[int, np.ndarray], read: list[tuple]) -> Found:
        model, place = divmod(key, _SLOTS)
        if place == _LOSS:
            return Found((*sums[0].tolist(), 0), None)
        task = of[model]
        if place < len(task.asked):
            return counted(task, task.asked[place], sums)
        bins, g, h = (np.frombuffer(b"".join(x), kind) for x, kind in zip(zip(*read, strict=True), (np.uint8, np.int32, np.int32), strict=True))
        return grow_from_rows(bins.reshape(-1, n_features), g, h, task.wanted[place - len(task.asked)][1], min_rows, l2)

    def answer(key: int, node: Found) -> pa.RecordBatch:
        nodes, rows = [node], []
        for k, x in enumerate(nodes):  # grows on the way
            below = len(nodes) if x.low else None
            if x.low:
                nodes += [x.low, x.high]
            s = x.split
            best = (s.gain, s.feature, s.bin, s.missing_left, *s.left) if s else (None,) * 7
            rows.append((key, k, below, *x.sums, *best, *(v for cut in x.guesses for v in cut or (None,) * 3)))
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in enumerate(_FOUND.types)], schema=_FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, dict[int, np.ndarray]] = {}
        read: dict[int, list[tuple]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                if r["sums"] is None:
                    read.setdefault(r["key"], []).append((r["bins"], r["g"], r["h"]))
                else:
                    mine, part = sums.setdefault(r["key"], {}), np.frombuffer(r["sums"], np.int64)
                    mine[r["node"]] = mine[r["node"]] + part if r["node"] in mine else part
        for key in (*sums, *read):
            yield answer(key, find(key, sums.get(key), read.pop(key, [])))

    return run


def _answer(rows: list[dict]) -> Found:
    """One key's rows, by ``node``, as the node with what is below it."""
    nodes = [
        Found(
            (r["n"], r["g"], r["h"]),
            None
            if r["gain"] is None
            else Split(r["gain"], r["feature"], r["bin"], r["missing_left"], (r["left_n"], r["left_g"], r["left_h"])),
            guesses=tuple(
                None if r[f"bin_{side}"] is None else tuple(r[f"{c}_{side}"] for c in _CUT) for side in ("low", "high")
            ),
        )
        for r in rows
    ]
    for r, x in zip(rows, nodes, strict=True):
        if r["below"] is not None:
            x.low, x.high = nodes[r["below"]], nodes[r["below"] + 1]
    return nodes[0]


def _by_bin(n_features: int) -> Callable:
    """A counted node's sums as rows, for the bins that have any."""

    def run(table: pa.Table) -> pa.Table:
        hist = _summed(table).reshape(n_features, _BINS, 3)
        f, b = np.nonzero(hist[..., 0])
        columns = [f.astype(np.int32), b.astype(np.int32), *hist[f, b].T.copy()]
        return pa.Table.from_arrays([pa.array(c) for c in columns], names=["f", "bin", "n", "g", "h"])

    return run


def _add_trees(recent: Sequence[Sequence[Tree]], n_features: int):
    """Blocks with their margins brought up to date."""
    schema = _block_schema(len(recent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, n_features, len(recent)):
            row = dict(block.row)
            for m, trees in enumerate(recent):
                if trees:
                    margin = block.margin(m).copy()
                    for tree in trees:
                        margin += tree.values(block.bins)
                    row[f"margin{m}"] = margin.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([row[c]], schema.field(c).type) for c in schema.names], schema=schema)

    return run


def _unpack(n_features: int, n_models: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _blocks(batches, n_features, n_models):
            # the model that left the row out, by the lowest bit that is not set
            out = [(~b.member >> m) & 1 for m in range(n_models)]
            model = np.argmax(out, axis=0)
            prob = _sigmoid(np.stack([b.margin(m) for m in range(n_models)])[model, np.arange(b.n)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(b.id), pa.array(model.astype(np.int32)), pa.array(prob)], names=["id", "model", "prob"]
            )

    return run


# ------------------------------------------------------------------------------ training
@dataclass
class _Model:
    model: BoostedTrees
    n_rows: int
    early: bool
    growing: GrowingTree | None
    recent: list[Tree] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)
    seen: dict[frozenset, Cut] = field(default_factory=dict)  # how the last trees cut a region

    def stopped(self, params: AnalysisParams) -> bool:
        wait = params.gbt_no_change
        if not self.early or len(self.losses) <= wait:
            return False
        return min(self.losses[-wait:]) > self.losses[-wait - 1] - 1e-7


class Boosting:
    """Several models over one frame; model m trains on the rows whose ``member`` has bit m.

    ``frame`` has an integer id, a 0/1 label, the features and ``member``.
    """

    def __init__(self, frame: DataFrame, label: str, id_col: str, params: AnalysisParams, n_models: int):
        self.params, self.n_models = params, n_models
        self.features = tuple(params.ltv_features)
        spark = frame.sparkSession
        # the rounds are small jobs over a fixed set of keys: no re-planning between their two stages
        self.session: SparkSession = spark.newSession()
        self.session.conf.set("spark.sql.adaptive.enabled", "false")
        self.finders = max(1, min(2 * n_models, spark.sparkContext.defaultParallelism))  # tasks that look for splits
        self.folder = f"{ensure_checkpoint_dir(spark)}/boosting-{uuid.uuid4().hex}"
        self.jobs = 0
        bits = [F.sum(F.when(F.col("member").bitwiseAND(1 << m) != 0, x)) for m in range(n_models) for x in (F.lit(1), F.col(label))]
        counted = frame.agg(*[b.alias(f"c{k}") for k, b in enumerate(bits)], F.count(F.lit(1)).alias("rows")).first()
        sizes = [(int(counted[2 * m] or 0), int(counted[2 * m + 1] or 0)) for m in range(n_models)]
        thresholds = bin_thresholds(frame, self.features, params.gbt_max_bins)
        baselines = [float(np.log((p + 1e-9) / (n - p + 1e-9))) if n else 0.0 for n, p in sizes]
        baselines = [min(max(b, -20.0), 20.0) for b in baselines]
        self.models = [
            _Model(
                BoostedTrees(self.features, thresholds, b),
                n,
                n > params.gbt_early_stopping_rows,
                self._tree(n) if 0 < p < n and params.gbt_max_iter else None,
            )
            for (n, p), b in zip(sizes, baselines, strict=True)
        ]
        early = sum(1 << m for m, x in enumerate(self.models) if x.early)
        tenth = F.pmod(F.xxhash64(F.col(id_col), F.lit(params.seed + 1)), F.lit(10)) == 0
        packed = frame.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(label).cast("int").alias("label"),
            F.col("member").cast("long").alias("member"),
            F.when(tenth, F.lit(early)).otherwise(0).cast("long").alias("valid"),
            *[F.col(c).cast("double").alias(c) for c in self.features],
        )
        # a task for every core, but none for a few rows; by id, so that a lost task packs the same rows again
        n_rows, cores = counted["rows"], spark.sparkContext.defaultParallelism
        parts = max(1, min(cores, n_rows // _TASK_ROWS[0]), n_rows // _TASK_ROWS[1])
        packed = packed.repartition(parts, "id").mapInArrow(_pack(thresholds, n_models, np.array(baselines)), _block_ddl(n_models))
        self.version = 0
        packed.write.parquet(self._path())
        self.blocks = self._read()
        self.persisted: list[DataFrame] = []

    def _tree(self, n_rows: int) -> GrowingTree:
        p = self.params
        return GrowingTree(p.gbt_max_leaves, p.gbt_min_rows_per_leaf, p.gbt_l2, n_rows, p.gbt_local_rows)

    def _path(self) -> str:
        return f"{self.folder}/{self.version}"

    def _read(self) -> DataFrame:
        return self.session.read.schema(_block_ddl(self.n_models)).parquet(self._path())

    def _sent(self, tasks: Sequence[_Task]) -> DataFrame:
        columns = ["n", *_PARTS[1:], *(f"margin{t.model}" for t in tasks)]
        sent = _send(tasks, len(self.features), self.n_models, self._deal(tasks))
        return self.blocks.select(*columns).mapInArrow(sent, _SENT_DDL)

    def _deal(self, tasks: Sequence[_Task]) -> dict[int, int]:
        """The task that looks for a key's splits, by key: those with most to do first, each to the
        task that has least. A read node counts by its rows, a counted one as a few thousand."""
        weight = {}
        for t in tasks:
            sums = self.models[t.model].growing.sums
            for place in range(len(t.nodes)):
                node = t.nodes[place]
                rows = 0 if place < len(t.asked) else sums[node][0] if node in sums else self.models[t.model].n_rows
                weight[t.model * _SLOTS + place] = 4000 + rows
            weight[t.model * _SLOTS + _LOSS] = 0
        load, dealt = [(0, k) for k in range(self.finders)], {}
        for key in sorted(weight, key=lambda key: (-weight[key], key)):
            least, k = heapq.heappop(load)
            dealt[key] = k
            heapq.heappush(load, (least + weight[key], k))
        return dealt

    def first_histogram(self, model: int = 0) -> DataFrame:
        """(feature, bin, customers, gradient, hessian) of the first round of one model."""
        sent = self._sent([_Task(model, self.models[model].growing.tree, (0,), (), False)])
        names = F.array(*map(F.lit, self.features))
        sums = sent.groupBy("key").applyInArrow(_by_bin(len(self.features)), "f int, bin int, n long, g long, h long")
        return sums.select(
            F.element_at(names, F.col("f") + 1).alias("feature"),
            "bin",
            F.col("n").alias("customers"),
            (F.col("g") / F.lit(float(_ONE))).alias("gradient"),
            (F.col("h") / F.lit(float(_ONE))).alias("hessian"),
        )

    def _tasks(self) -> list[_Task]:
        """A task for every model whose tree is not grown."""
        return [
            _Task(m, x.growing.with_guesses(x.seen), tuple(x.growing.asked), tuple(x.growing.wanted.items()), x.early and x.growing.starts)
            for m, x in enumerate(self.models)
            if x.growing and x.growing.kept is None
        ]

    def _round(self, tasks: list[_Task]) -> None:
        """One round, one job, for all models that still grow a tree."""
        p = self.params
        found = self._sent(tasks).repartitionById(self.finders, F.col("task")).mapInArrow(
            _find(tasks, len(self.features), p.gbt_min_rows_per_leaf, p.gbt_l2, p.gbt_local_rows), _FOUND_DDL
        )
        rows = found.toArrow().to_pylist()  # at most a split per node of the trees
        self.jobs += 1
        by_key: dict[int, list[dict]] = {}
        for r in sorted(rows, key=lambda r: (r["key"], r["node"])):
            by_key.setdefault(r["key"], []).append(r)
        for old in self.persisted[:-1]:  # the last one is complete now
            old.unpersist()
        self.persisted = self.persisted[-1:]
        for task in tasks:
            x = self.models[task.model]
            first = task.model * _SLOTS
            loss = by_key.get(first + _LOSS)
            if loss:
                x.losses.append(float(loss[0]["g"]) / _ONE / float(loss[0]["n"]))
                if x.stopped(p):
                    x.growing = None
                    continue
            x.growing.receive({node: _answer(by_key[first + k]) for k, node in enumerate(task.nodes) if first + k in by_key})

    def _take_trees(self) -> None:
        """The grown trees join their models and the margins; the next ones begin."""
        for x in self.models:
            x.recent = []
            if x.growing:
                tree = x.growing.grown(self.params.gbt_step_size)
                x.growing.remember(x.seen)
                x.recent.append(tree)
                x.model.trees.append(tree)
                more = len(x.model.trees) < self.params.gbt_max_iter and x.growing.kept
                x.growing = self._tree(x.n_rows) if more else None
        if any(x.recent for x in self.models):
            self.blocks = self.blocks.mapInArrow(
                _add_trees([x.recent for x in self.models], len(self.features)), _block_ddl(self.n_models)
            )

    def _refresh(self) -> None:
        """Write the blocks with the margins of all trees so far; the older ones go."""
        old = self._path()
        self.version += 1
        self.blocks.write.parquet(self._path())
        self.blocks = self._read()
        self.jobs += 1
        self._release()
        remove_path(self.session, old)

    def _release(self) -> None:
        for old in self.persisted:
            old.unpersist()
        self.persisted = []

    def fit(self) -> list[BoostedTrees]:
        unwritten = 0
        try:
            while any(x.growing for x in self.models):
                while tasks := self._tasks():
                    self._round(tasks)
                self._take_trees()
                unwritten += 1
                if unwritten == self.params.gbt_refresh or not any(x.growing for x in self.models):
                    self._refresh()
                    unwritten = 0
                else:
                    self.persisted.append(self.blocks.persist(StorageLevel.MEMORY_AND_DISK))
        finally:
            self._release()
        return [x.model for x in self.models]

    def left_out(self) -> DataFrame:
        """(id, model, prob): every row's probability under the first model that did not train on it."""
        return self.blocks.mapInArrow(_unpack(len(self.features), self.n_models), "id long, model int, prob double")
