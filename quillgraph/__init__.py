"""Analytics over linked collections of text, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions of this package travel inside the plan, so executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
