"""Code-review analytics on Spark: scan, number, extract, slice, review, route and report."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions handed to Python workers travel by value, so executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
