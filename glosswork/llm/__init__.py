"""Operators for preparing large text corpora for language-model training.

Nothing else in the library imports this subpackage.  Functions that run in
Python workers are pickled by value, so executors do not need the package on
their import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
