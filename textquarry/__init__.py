"""A Spark-first engine for document retrieval and corpus preparation."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions that run in Python workers travel by value, so executors need no
# installed copy of this package.
register_pickle_by_value(sys.modules[__name__])
