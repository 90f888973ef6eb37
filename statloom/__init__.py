"""Statistical analytics on Spark DataFrames.

Operators take DataFrames and column names and return DataFrames.  Row work is
expressions, windows and grouped aggregates; only bounded summaries (a p x p
matrix, a level list, a handful of range boundaries) ever reach the driver.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Helpers travel inside the task, so executors need no copy of the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
