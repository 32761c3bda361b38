"""How the filters of a corpus interact, by count-weighted decision diagrams.

One pass turns every text into a mask of failed filters; the table then shrinks to counts per
(part, mask), at most 2^filters rows a part. Per part those counts become a decision diagram:
a level per filter, a pass and a fail branch per node, equal nodes shared, and every node
weighted with the documents below it. Along the all-pass path of an order, the node of a step
holds what is left, its fail branch what the step removes. The orders are visited so that
each differs from the one before by one swap of adjacent levels, which touches those two
levels only and leaves all weights as they are.

The filters A to E of ``failure_masks``: under 100 words; 100 * distinct words < 80 * words;
over a tenth of the code points in A-Z; any of ``#$%&*|``; text identical to a smaller doc_id's.

Scale: texts are read once and never shuffled, only their SHA-256, ids and masks are; copies
are counted before they meet by content, so a text held by a third of all rows is one row
per task, part and label.

Rows: a null or empty text has no words and fails A only (and E, if a smaller doc_id's text
is null or empty too); texts may be of any length. A null ``lang`` is the part ''. Rows that
repeat a doc_id are counted one by one; they do not make each other fail E. A null doc_id is
not smaller than any, has no smaller one, and no labels. A doc_id labelled twice is good or toxic if
either label says so. Only named columns are read, so further columns of any name do no
harm. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import text_words

#: Fixed values of the filters.
FILTERS = "ABCDE"
MIN_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
SYMBOLS = b"#$%&*|"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))

#: What is counted per mask: documents, those of good quality, toxic ones.
WEIGHTS = ("n", "good", "toxic")

STEPS = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, "
    "unique_fails long, good_lost long, toxic_lost long, shapley long"
)


# ------------------------------------------------------------------ masks and their counts
def text_mask(text: str | None) -> int:
    """Bits 0 to 3: the filters A to D that the text fails."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = text_words(text)
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * (len(raw) - len(raw.translate(None, _UPPER))) > UPPER_PERCENT * len(text)) << 2
        | (len(raw) > len(raw.translate(None, SYMBOLS))) << 3
    )


def _mask(text: Column) -> Column:
    @F.pandas_udf("int")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([text_mask(t) for t in texts], dtype="int32")

    return of(text)


def _flags(labels: DataFrame) -> DataFrame:
    is_one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).cast("int")
    return (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("labelled"))
        .agg(is_one("quality").alias("good"), is_one("toxic").alias("toxic"))
    )


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents per part and mask of failed filters A to E."""
    rows = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce("lang", F.lit("")).alias("part"),
            F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("content"),
            _mask(F.col("text")).alias("mask"),
        )
        .groupBy("content", "doc_id", "part", "mask")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # rows without an id have no label; their keys are spread, so that they do not meet in one task
    spread = F.when(F.col("doc_id").isNull(), F.crc32("content")).otherwise(0)
    flagged = (
        rows.withColumn("spread", spread)
        .join(
            _flags(labels).withColumn("spread0", F.lit(0).cast("long")),
            (F.col("doc_id") == F.col("labelled")) & (F.col("spread") == F.col("spread0")),
            "left",
        )
        .select("content", "doc_id", "part", "mask", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    )
    # of equal texts, the rows of the smallest id pass E; a group keeps its own smallest id with its rows
    groups = flagged.groupBy("content", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_without"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low"),
    )
    first = F.min("low.doc_id").over(Window.partitionBy("content"))
    passing = F.col("n_without") + F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0)
    both = F.array(
        F.struct(F.col("mask").alias("mask"), F.col("passing").alias("n")),
        F.struct(F.col("mask").bitwiseOR(F.lit(1 << 4)).alias("mask"), (F.col("n") - F.col("passing")).alias("n")),
    )
    return (
        groups.withColumn("first", first)
        .withColumn("passing", passing)
        .select("part", "good", "toxic", F.inline(both))
        .where("n > 0")
        .groupBy("part", "mask")
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("good")).alias("good"),
            F.sum(F.col("n") * F.col("toxic")).alias("toxic"),
        )
    )


# --------------------------------------------------------------------------- the diagrams
class Diagram:
    """Decision diagram over masks: level k tests ``order[k]``; a node has (pass, fail) children and weights.

    Every path runs through all levels, so a node's weight is the sum of its children's.
    ``levels[k]`` holds the nodes of level k by their children: equal ones are one node. The
    last level's children are the weights themselves.
    """

    def __init__(self, counts: dict[int, tuple[int, ...]], order: Sequence[int]):
        self.order = list(order)
        self.none = (0,) * len(next(iter(counts.values()), WEIGHTS))
        self.kids: list[tuple] = []
        self.weight: list[tuple[int, ...]] = []
        self.levels: list[dict[tuple, int]] = [{} for _ in self.order]
        self.root = self._build(counts, 0)

    def _weight(self, level: int, child) -> tuple[int, ...]:
        return child if level + 1 == len(self.order) else self.weight[child]

    def _node(self, level: int, low, high) -> int:
        found = self.levels[level].get((low, high))
        if found is None:
            found = self.levels[level][low, high] = len(self.kids)
            self.kids.append((low, high))
            self.weight.append(tuple(a + b for a, b in zip(self._weight(level, low), self._weight(level, high))))
        return found

    def _build(self, counts: dict[int, tuple[int, ...]], level: int):
        if level == len(self.order):
            return next(iter(counts.values()), self.none)  # one mask is left at most
        bit = 1 << self.order[level]
        sides = [{m: w for m, w in counts.items() if bool(m & bit) == failed} for failed in (False, True)]
        return self._node(level, *(self._build(side, level + 1) for side in sides))

    def swap(self, level: int) -> None:
        """Exchange the filters of ``level`` and the level below it.

        A node keeps its place in the levels above, its weight and its grandchildren; only
        which of them meet in a child changes. Two nodes of the level stay different.
        """
        below, self.levels[level + 1] = self.levels[level], {}
        self.levels[level] = {}
        for (low, high), node in below.items():
            (a, b), (c, d) = self.kids[low], self.kids[high]
            kids = self._node(level + 1, a, c), self._node(level + 1, b, d)
            self.kids[node] = kids
            self.levels[level][kids] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def all_pass(self) -> Iterator[tuple[int, tuple[int, ...], tuple[int, ...]]]:
        """(filter, weights that pass it, weights that it removes), step by step."""
        node = self.root
        for level, filter_ in enumerate(self.order):
            low, high = self.kids[node]
            yield filter_, self._weight(level, low), self._weight(level, high)
            node = low


def adjacent_swaps(n: int) -> Iterator[int]:
    """Swaps (k: of the places k and k + 1) that lead through all orders of n things."""
    if n < 2:
        return
    inner, down = adjacent_swaps(n - 1), True
    while True:  # the last thing walks from end to end, then the others take one step
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(inner, None)
        if step is None:
            return
        yield step + down  # the walker stands first after its way down
        down = not down


def audit_part(counts: dict[int, tuple[int, ...]], filters: str = FILTERS) -> list[tuple]:
    """Rows of ``STEPS`` without the part: every order and step from a part's weights per mask."""
    diagram = Diagram(counts, range(len(filters)))
    paths = [(tuple(diagram.order), list(diagram.all_pass()))]
    for k in adjacent_swaps(len(filters)):
        diagram.swap(k)
        paths.append((tuple(diagram.order), list(diagram.all_pass())))
    removed_sum, fails, unique = ([0] * len(filters) for _ in range(3))
    for _, path in paths:
        for f, _, removed in path:
            removed_sum[f] += removed[0]
        fails[path[0][0]] = path[0][2][0]  # as the first step a filter removes all that fail it,
        unique[path[-1][0]] = path[-1][2][0]  # as the last one what no other removes
    return [
        (
            "".join(filters[f] for f in order),
            step,
            kept[0],
            removed[0],
            fails[f] - removed[0],
            unique[f],
            removed[1],
            removed[2],
            removed_sum[f],
        )
        for order, path in paths
        for step, (f, kept, removed) in enumerate(path, 1)
    ]


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """All orders and steps of every part, from (part, mask, n, good, toxic); one diagram per part."""
    columns = [c.split()[0] for c in STEPS.split(", ")]

    def of(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:  # at most 2^filters rows
        counts = {int(m): w for m, *w in pdf[["mask", *WEIGHTS]].itertuples(index=False, name=None)}
        counts = {m: tuple(map(int, w)) for m, w in counts.items()}
        return pd.DataFrame([(key[0], *row) for row in audit_part(counts, filters)], columns=columns)

    return masks.groupBy("part").applyInPandas(of, STEPS)
