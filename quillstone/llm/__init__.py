"""Operators that prepare text corpora for model training.

Nothing else in the library imports this subpackage.  The task-side functions
travel to the executors by value, so the workers need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
