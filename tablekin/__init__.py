"""Table union search and lake profiling as Spark DataFrame jobs.

The package's functions travel to executors by value, so executors need Python's libraries but
no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
