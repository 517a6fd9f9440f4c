"""Operators for training-data pipelines. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, so these need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
