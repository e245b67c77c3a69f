"""Document retrieval, evaluation and corpus preparation as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value, so that these need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
