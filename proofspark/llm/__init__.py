"""Operators for preparing training data: filtering, near-duplicates, mixing, sharding, packing."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so that nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
