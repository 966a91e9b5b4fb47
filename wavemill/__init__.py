"""wavemill: deterministic integer signal analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
