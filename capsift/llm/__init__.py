"""Operators for training-data pipelines; nothing else in the library imports them.

Functions that run in Python workers travel with the job (pickled by value), so the
executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
