"""Estimate a classifier's performance on data of which only feature means are known, with Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors with their code, so that nothing has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
