"""Operators of a training-data pipeline (see each module)."""

import sys

from pyspark import cloudpickle

# Functions for tasks travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
