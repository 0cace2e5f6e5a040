"""Profiling and forecasting of large panels of time series as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The functions that run inside tasks travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
