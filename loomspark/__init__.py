"""Analytics over course-text tables, written for Spark's DataFrame engine."""

from pyspark import cloudpickle as _cloudpickle
import sys as _sys

# Functions handed to Python workers are shipped by value, so an executor needs
# nothing but the libraries: the package itself need not be installed there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
