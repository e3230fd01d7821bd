"""cellsift: droplet count analytics and data preparation on Spark DataFrames."""

from pyspark import cloudpickle as _cloudpickle

import cellsift as _self

# Functions sent to Python workers travel by value, so that the executors need no copy of this package.
_cloudpickle.register_pickle_by_value(_self)
