"""Operators for training-data pipelines. Kernels travel with the tasks, so executors need no copy of this package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
