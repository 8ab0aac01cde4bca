"""corvane: batch retrieval and document analytics on Apache Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python workers get this package's functions with the task, so that executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
