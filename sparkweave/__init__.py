"""Graph-relational analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions of this package travel to executors by value: nothing has to be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
