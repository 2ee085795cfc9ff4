"""Table detection over large document collections, as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their tasks, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
