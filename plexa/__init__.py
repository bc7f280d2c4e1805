"""Spark-native graph analytics and text-corpus operators.

Functions of this package are pickled by value, so executors need not have
it installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
