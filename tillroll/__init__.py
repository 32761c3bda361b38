"""tillroll — retail line-item analytics as Spark DataFrame operators."""

from .params import AnalysisParams, test_table_params

__all__ = ["AnalysisParams", "test_table_params"]
