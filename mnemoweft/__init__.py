"""mnemoweft: topic-organised memory analytics, written for Spark.

Every operator is a function from DataFrames to a DataFrame.  Operators never read the wall
clock, give every ordering a unique tie-break and take every threshold as a parameter.
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Functions of this package travel to the Python workers by value, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
