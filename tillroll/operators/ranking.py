"""Scalable global ranking and quantile bins.

``row_number()`` over an unpartitioned window moves every row into one task. Here the
rows are range-partitioned and sorted by the order key (Spark samples the key to pick
balanced ranges, so heavy ties spread out because the key ends in a unique column),
each row gets its in-partition position from ``monotonically_increasing_id``, and one
row per partition (its size) yields the partition offsets, broadcast back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

_PART = "_rk_part"
_MONO = "_rk_mono"


def global_rank(
    df: DataFrame,
    order_cols: Sequence[str | Column],
    rank_col: str = "rank",
    total_col: str | None = None,
) -> DataFrame:
    """Dense 1..n rank in ``order_cols`` order (= ``row_number()`` over the whole frame).

    ``order_cols`` must end in a unique key so the order is total. The sorted, id-tagged
    frame is checkpointed to ``spark.checkpoint.dir`` so the offsets and the positions
    are read from the same files even if an executor is lost and tasks are re-run.
    """
    tagged = df.orderBy(*order_cols).select(
        "*", F.spark_partition_id().alias(_PART), F.monotonically_increasing_id().alias(_MONO)
    )
    tagged = reliable_checkpoint(tagged)
    sizes = tagged.groupBy(_PART).agg(F.count(F.lit(1)).alias("_rk_n"))
    # one row per non-empty partition: the window below is bounded by the partition count
    offsets = sizes.select(
        _PART,
        (F.sum("_rk_n").over(Window.orderBy(_PART)) - F.col("_rk_n")).alias("_rk_offset"),
        F.sum("_rk_n").over(Window.partitionBy()).alias("_rk_total"),
    )
    local = F.col(_MONO) - F.shiftleft(F.col(_PART).cast("long"), 33)
    out = tagged.join(F.broadcast(offsets), _PART).withColumn(rank_col, F.col("_rk_offset") + local + 1)
    if total_col:
        out = out.withColumnRenamed("_rk_total", total_col)
    return out.drop(_PART, _MONO, "_rk_offset", "_rk_total")


def rank_bin(rank: Column | str, n: Column | str, n_bins: int = 5) -> Column:
    """Quantile bin of a 1..n rank, exactly as equal-frequency cuts of the ranks.

    Edge k sits at 1 + k(n-1)/q; bins are right-closed, so
    bin = 1 + #{k in 1..q-1 : 5(rank-1) > k(n-1)}, in integers (no float edges).
    Not ``ntile``: for n = 4279 this gives 856, 856, 855, 856, 856.
    """
    r = F.col(rank) if isinstance(rank, str) else rank
    nn = F.col(n) if isinstance(n, str) else n
    terms = [F.when(F.lit(n_bins) * (r - 1) > F.lit(k) * (nn - 1), 1).otherwise(0) for k in range(1, n_bins)]
    out = F.lit(1)
    for t in terms:
        out = out + t
    return out.cast("int")


def order_statistics(df: DataFrame, order_cols: Sequence[str], ranks: Sequence[int]) -> dict[int, Row]:
    """The rows at the given 1-based ranks of ``order_cols`` order (which ends in a unique key).

    Only ``order_cols`` are sorted and checkpointed, and only the asked rows reach the driver.
    """
    wanted = sorted(set(ranks))
    if not wanted:
        return {}
    ranked = global_rank(df.select(*order_cols), list(order_cols), "_pos")
    return {int(r["_pos"]): r for r in ranked.where(F.col("_pos").isin(*wanted)).collect()}


def counted_statistics(df: DataFrame, value_col: str, positions: Sequence[int]) -> dict[int, int]:
    """The values at 0-based positions of the sorted column, from its per-value counts.

    The counts are ranged over partitions and summed up there; one row per partition gives
    the offsets. The driver receives one row per position, whatever the number of values.
    """
    counts = df.groupBy(value_col).agg(F.count(F.lit(1)).alias("_c"))
    part = reliable_checkpoint(counts.orderBy(value_col).select("*", F.spark_partition_id().alias(_PART)))
    offsets = part.groupBy(_PART).agg(F.sum("_c").alias("_s"))
    # one row per non-empty partition
    offsets = offsets.select(_PART, (F.sum("_s").over(Window.orderBy(_PART)) - F.col("_s")).alias("_off"))
    upto = F.sum("_c").over(Window.partitionBy(_PART).orderBy(value_col)) + F.col("_off")
    wanted = F.array(*[F.lit(int(k)).cast("long") for k in sorted(set(positions))])
    found = (
        part.join(F.broadcast(offsets), _PART)
        .withColumn("_upto", upto)
        .select(
            F.col(value_col).alias("v"),
            F.explode(F.filter(wanted, lambda k: (k < F.col("_upto")) & (k >= F.col("_upto") - F.col("_c")))).alias("k"),
        )
    )
    return {int(r["k"]): r["v"] for r in found.collect()}


def value_quantile_edges(df: DataFrame, value_col: str, n_bins: int = 5) -> list[tuple[int, int, int, int]]:
    """Exact linear-interpolation quantile edges of an integer column, as rationals.

    Returns for each k in 0..q: (x_lo, x_hi, r, q) meaning edge = x_lo + r/q (x_hi - x_lo).
    """
    n = df.where(F.col(value_col).isNotNull()).count()
    if not n:
        raise ValueError(f"no rows to bin on {value_col}")
    at = [divmod(k * (n - 1), n_bins) for k in range(n_bins + 1)]
    got = counted_statistics(
        df.where(F.col(value_col).isNotNull()), value_col, [p for pos, rem in at for p in ((pos, pos + 1) if rem else (pos,))]
    )
    return [(int(got[pos]), int(got[pos + 1] if rem else got[pos]), rem, n_bins) for pos, rem in at]


def interpolated_quantiles(df: DataFrame, value_col: str, quantiles: Sequence[float]) -> list[float] | None:
    """Exact linear-interpolation quantiles of a numeric column; None without rows."""
    rows = df.where(F.col(value_col).isNotNull())
    n = rows.count()
    if not n:
        return None
    at = [(int(q * (n - 1) // 1), q * (n - 1)) for q in quantiles]
    got = counted_statistics(rows, value_col, [min(p + d, n - 1) for p, _ in at for d in (0, 1)])
    out = []
    for p, exact in at:
        a, b = float(got[p]), float(got[min(p + 1, n - 1)])
        out.append(a + (b - a) * (exact - p))
    return out


def rank_score(df: DataFrame, order_cols: Sequence[str], n: int, n_bins: int = 5) -> Column:
    """W2 without carrying ranks: compare ``order_cols`` with the first row of each higher bin.

    Bin k starts at the smallest rank r with q(r-1) > (k-1)(n-1), so a row's bin is 1 + the
    number of those rows that are not after it.
    """
    first = [k * (n - 1) // n_bins + 2 for k in range(1, n_bins)]
    cuts = order_statistics(df, order_cols, [r for r in first if r <= n])
    own = F.struct(*[F.col(c) for c in order_cols])
    out = F.lit(1)
    for r in first:
        if r in cuts:
            row = F.struct(*[F.lit(cuts[r][c]).cast(df.schema[c].dataType).alias(c) for c in order_cols])
            out = out + F.when(own >= row, 1).otherwise(0)
    return out.cast("int")


def value_bin(value: Column | str, edges: list[tuple[int, int, int, int]]) -> Column:
    """1 + #{inner edges below value}; ties share a bin; exact integer compare.

    Raises if two edges coincide (the equal-frequency cut is then undefined).
    """
    exact = [(x_lo * q + r * (x_hi - x_lo), q) for x_lo, x_hi, r, q in edges]
    for (a, q), (b, _) in zip(exact, exact[1:]):
        if a == b:
            raise ValueError(
                "quantile bin edges coincide; the value distribution cannot be cut into equal-frequency bins"
            )
    v = F.col(value) if isinstance(value, str) else value
    out = F.lit(1)
    for num, q in exact[1:-1]:
        out = out + F.when(v.cast("long") * q > F.lit(num), 1).otherwise(0)
    return out.cast("int")
