"""Linked-data and training-data analytics on PySpark."""
import sys

from pyspark import cloudpickle

# Functions that Spark sends to Python workers travel by value, so executors
# need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
