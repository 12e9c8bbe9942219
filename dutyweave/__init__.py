"""Goods classification, import requirements and corpus operators as Spark jobs.

Functions of this package that run inside tasks travel to the executors by value,
so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
