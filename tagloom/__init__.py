"""Annotated-review analytics on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their tasks by value, so executors need
# numpy and pandas but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
