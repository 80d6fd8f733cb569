"""rillwork: retrieval and corpus processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions go to the executors by value, so these need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
