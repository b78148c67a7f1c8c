"""Operators for preparing training text. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions of this package are sent to executors with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
