"""mosaicq: raster, token and corpus analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions go to the executors by value, so the package need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
