"""quillstream: a PySpark-native engine for lakehouse feeds, text indexes and their repair."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, so that only the driver needs it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
