"""Parlance: dialogue and text analytics on PySpark.

Functions shipped to Python workers are pickled by value, so executors need
no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
