"""Feedback evidence analytics as PySpark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# task functions travel by value, so executors need no installed copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
