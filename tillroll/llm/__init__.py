"""Operators for large-scale training-data pipelines (dedup, mixing, scans, tokenizing, ...).

The functions that run inside Python tasks travel with the tasks, so executors need the
listed libraries (numpy, pandas, ...) but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
