"""paperloom: a Spark-native engine for literature-review analytics.

Functions that run on executors are pickled by value, so the executors need Python's libraries, but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
