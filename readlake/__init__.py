"""readlake: analytics on sequencing reads, their alignments and texts, as DataFrame operators for Spark."""

__version__ = "0.1.0"

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# functions that run in Python workers travel with the plan, so that executors need no copy of the package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
