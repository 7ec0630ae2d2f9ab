"""Text metrics and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

#: Functions of this package travel to the executors with the job; the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
