"""Operators of a training-data pipeline: thirteen independent ones, each from table to table.

Nothing else in the library imports this package. ``queries`` holds the registered queries.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the plan: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
