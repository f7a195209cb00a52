"""Evidence, lineage and evaluation jobs over Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python helpers travel inside the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
