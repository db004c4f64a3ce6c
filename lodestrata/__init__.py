"""Spark-native code-intelligence and incident analytics."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value, so that workers needn't have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
