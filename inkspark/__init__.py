"""inkspark: PDF text extraction and document analytics on Spark DataFrames."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

__version__ = "0.1.0"

# Python workers need not be able to import this package: its functions travel by value.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
