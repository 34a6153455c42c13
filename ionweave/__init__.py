"""Spark-first mass-spectrometry search and large-table analytics."""

import sys

from pyspark import cloudpickle

# Kernels travel to the executors by value, so that a cluster needs no installation of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
