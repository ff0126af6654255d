"""Operators for training data: packing, quality, toxicity, duplicates, sharding, archives, filters.

Everything here stands beside the outreach library and is imported by nothing in it. Functions that
run inside Python tasks travel to the executors by value, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
