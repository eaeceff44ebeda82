"""Privacy, quality, constraint and synthesis operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The small helpers that run in Python workers travel with their closures, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
