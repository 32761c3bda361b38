"""RFM scoring, segments and the score map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.segments import SEGMENT_NAMES, segment_expr
from ..params import AnalysisParams
from ..sources.schema import CUSTOMER_COLUMNS
from ..session import reliable_checkpoint
from .ranking import rank_score, value_bin, value_quantile_edges


def rfm_scores(customers: DataFrame, params: AnalysisParams) -> DataFrame:
    """R from value quantiles of -Recency; F and M from ranks (ties by CustomerID).

    The customers are checkpointed once. Ranks sort (value, CustomerID) alone, and scores
    are comparisons with the few cut rows read from them.
    """
    q = params.n_bins
    customers = reliable_checkpoint(customers)
    n = customers.count()
    if not n:
        none = F.lit(None).cast("int")
        return customers.withColumns({"R_score": none, "F_score": none, "M_score": none})
    r_edges = value_quantile_edges(customers.select((-F.col("Recency")).alias("_neg_recency")), "_neg_recency", q)
    return customers.withColumns(
        {
            "R_score": value_bin(-F.col("Recency"), r_edges),
            "F_score": rank_score(customers, ["Frequency", "CustomerID"], n, q),
            "M_score": rank_score(customers, ["Monetary", "CustomerID"], n, q),
        }
    )


def assign_segments(scored: DataFrame) -> DataFrame:
    """P12 applied to every customer."""
    return scored.withColumn("Segment", segment_expr())


def customer_frame(scored_with_segment: DataFrame) -> DataFrame:
    """IO4 projection: the 19 customer columns in fixed order (Monetary as double)."""
    return scored_with_segment.withColumn("Monetary", F.col("Monetary").cast("double")).select(*CUSTOMER_COLUMNS)


def segment_map(spark: SparkSession, n_bins: int = 5) -> DataFrame:
    """Every (R, F, M) score triple and its segment (125 rows for 5 bins).

    Generated with ``explode(sequence)`` instead of cross joins.
    """
    s = F.sequence(F.lit(1), F.lit(n_bins))
    return (
        spark.range(1)
        .select(F.explode(s).alias("R"))
        .select("R", F.explode(s).alias("F"))
        .select("R", "F", F.explode(s).alias("M"))
        .withColumn("Segment", segment_expr("R", "F", "M"))
    )


def segment_map_counts(seg_map: DataFrame) -> DataFrame:
    """Triples per segment, every one of the 11 names listed (0 if absent)."""
    names = seg_map.sparkSession.createDataFrame(
        [(i, n) for i, n in enumerate(SEGMENT_NAMES)], "name_order int, Segment string"
    )
    counts = seg_map.groupBy("Segment").agg(F.count(F.lit(1)).alias("triples"))
    return (
        names.join(counts, "Segment", "left")
        .select("Segment", F.coalesce("triples", F.lit(0)).cast("bigint").alias("triples"), "name_order")
        .orderBy("name_order")
        .drop("name_order")
    )


def rfm_triple_counts(scored_with_segment: DataFrame) -> DataFrame:
    """Customers per observed (R, F, M) triple with its segment from the score map."""
    seg_map = segment_map(scored_with_segment.sparkSession)
    counts = scored_with_segment.groupBy("R_score", "F_score", "M_score").agg(
        F.count(F.lit(1)).alias("customers"), F.sum("Monetary").cast("double").alias("revenue")
    )
    # the score map has exactly n_bins^3 rows, a size fixed by the parameters
    return counts.join(
        F.broadcast(seg_map.withColumnsRenamed({"R": "R_score", "F": "F_score", "M": "M_score"})),
        ["R_score", "F_score", "M_score"],
    )
