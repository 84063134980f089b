"""Passage retrieval and citation checking over whole tables, as Spark jobs.

Functions that run in tasks travel to the executors by value, so the workers need no
copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
