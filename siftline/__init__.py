"""Siftline: a PySpark-native search, ranking and corpus-processing engine."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions that run in Python workers travel with their code, so executors need no installation
cloudpickle.register_pickle_by_value(sys.modules[__name__])
