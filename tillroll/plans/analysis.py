"""The analysis over a line-item source.

Stages are properties built on first use. Most are lazy plans; three steps run jobs while
they are built, because later rows depend on values or files from them: the line grain
(checkpointed when several reports read it), the customer features (checkpointed for the
ranks) and the cut rows of the RFM scores. Once the line grain is stored, customers, KPIs,
cohorts and the counts of the cleaning log are all folded from it and the source is not
read again. Checkpoints go to the shared
``spark.checkpoint.dir``. With ``cache`` the cleaned lines and the scored customers are
persisted (MEMORY_AND_DISK); both are pure functions of their input, so recomputation after
a lost executor gives the same rows.
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from ..operators import clean as CL
from ..operators import cohorts as H
from ..operators import customers as CU
from ..operators import kpis as K
from ..operators import profile as Q
from ..operators import rfm as W
from ..operators import segments as S
from ..params import AnalysisParams, test_table_params
from ..session import configure, reliable_checkpoint
from ..sources import tpch_adapter
from ..sources.io import load_line_items


class RetailAnalysis:
    """All operators of the study over one raw line-item DataFrame."""

    def __init__(
        self,
        raw: DataFrame,
        params: AnalysisParams,
        windowed_raw: DataFrame | None = None,
        cache: bool = True,
    ):
        self.params = params
        self.cache = cache
        self._persisted: list[DataFrame] = []
        self.raw = raw
        # same rows inside the window, but with a source-side pre-trim (pushdown)
        self._windowed_raw = raw if windowed_raw is None else windowed_raw

    @classmethod
    def from_test_tables(
        cls, spark: SparkSession, sf_dir: str, params: AnalysisParams | None = None, cache: bool = True
    ):
        configure(spark)
        params = params or test_table_params()
        tables = tpch_adapter.read_tables(spark, sf_dir)
        return cls(
            tpch_adapter.line_items(spark, sf_dir, tables=tables),
            params,
            windowed_raw=tpch_adapter.line_items(spark, sf_dir, params, tables=tables),
            cache=cache,
        )

    @classmethod
    def from_stored(
        cls, spark: SparkSession, path: str, params: AnalysisParams, fmt: str = "parquet", cache: bool = True, **options
    ):
        """Over stored line items; the window reads only its months if they are stored by month."""
        configure(spark)
        return cls(
            load_line_items(spark, path, fmt, **options),
            params,
            windowed_raw=load_line_items(spark, path, fmt, params, **options),
            cache=cache,
        )

    @property
    def spark(self) -> SparkSession:
        return self.raw.sparkSession

    def _keep(self, df: DataFrame) -> DataFrame:
        if not self.cache:
            return df
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._persisted.append(df)
        return df

    def close(self) -> None:
        for df in self._persisted:
            df.unpersist()
        self._persisted.clear()

    # ---- stage C
    @cached_property
    def clean(self) -> DataFrame:
        return self._keep(CL.clean_line_items(self._windowed_raw, self.params))

    @property
    def with_customer(self) -> DataFrame:
        return CL.with_customer(self.clean)

    # ---- stage D
    @cached_property
    def grain(self) -> DataFrame:
        """The line grain of the cleaned lines, stored once for all reports that are folded from it."""
        return reliable_checkpoint(CU.line_grain(self.clean))

    @property
    def _stored_grain(self) -> DataFrame | None:
        return self.__dict__.get("grain")

    @cached_property
    def features(self) -> DataFrame:
        """All attributed customers (before the net-positive filter); from the line grain
        once it is stored, else straight from the lines."""
        return CU.customer_features(self.with_customer, self.params, self._stored_grain)

    @cached_property
    def scored(self) -> DataFrame:
        """Net-positive customers with R/F/M scores and segment."""
        positive = CU.net_positive(self.features)
        return self._keep(W.assign_segments(W.rfm_scores(positive, self.params)))

    @property
    def customers(self) -> DataFrame:
        return W.customer_frame(self.scored)

    # ---- stage E
    @cached_property
    def segment_summary(self) -> DataFrame:
        return S.segment_summary(self.scored)

    def headline_kpis(self) -> DataFrame:
        return K.headline_kpis(self.grain, self.scored, self.params)

    def cleaning_log(self) -> DataFrame:
        stored = self._stored_grain
        counts = CL.line_counts(self.clean, self.params) if stored is None else CL.grain_counts(stored, self.params)
        return CL.cleaning_log(self.raw, counts, self.features, self.params)

    def month_masks(self) -> DataFrame:
        lines = self.with_customer if self._stored_grain is None else self._stored_grain
        return H.month_masks(lines, self.params)

    def retention_long(self) -> DataFrame:
        return H.retention_by_bits(self.month_masks(), self.params)

    def retention_targets(self) -> DataFrame:
        return S.retention_targets(self.segment_summary, self.params)

    def guard_rails(self) -> DataFrame:
        return K.kpi_guard_rails(self.headline_kpis(), S.top_segment(self.segment_summary), self.params)

    def profile(self) -> "Q.Profile":
        return Q.Profile(self.raw, self.params)
