"""Operators for preparing large text corpora; nothing else in the package imports this subpackage.

Functions that run on executors are pickled by value, so the executors need only numpy and pyarrow, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
