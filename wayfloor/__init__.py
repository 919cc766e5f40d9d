"""Robot-accessibility analytics on Spark: points, grids, ramps, coverage and semantics as DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
