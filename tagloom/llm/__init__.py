"""Operators for large-scale training-data preparation; nothing else in the library imports this.

Functions that run in Python workers travel with their tasks by value, so the executors need
numpy and pyarrow but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
