"""A PySpark-native engine for storing, searching and assembling context records."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
