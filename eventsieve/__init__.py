"""Near-duplicate news, page and visitor analytics on plain Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions travel to executors by value: none needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
