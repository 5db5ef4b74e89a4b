"""Operators for training-data corpora; nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions shipped to the executors travel by value: the executors need the
# third-party packages only, not this one.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
