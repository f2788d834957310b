"""Trace analytics for tool-using agents on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get this package's functions with the task; nothing has to be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
