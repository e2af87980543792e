"""Spark-native analytics over program-context data."""

import sys

from pyspark import cloudpickle

# Functions of this package go to executors by value, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
