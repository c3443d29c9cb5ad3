"""Analytics for ordered sensor series and training data, written for Spark."""

import sys

from pyspark import cloudpickle

# Kernels travel to the Python workers by value: the package need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
