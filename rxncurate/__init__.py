"""Batch jobs on Spark DataFrames that curate, score and denoise chemical-reaction data."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their tasks: workers need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
