"""Longitudinal response analytics and corpus preparation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the tasks that call them, so that executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
