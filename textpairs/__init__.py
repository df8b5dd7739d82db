"""Text-pair (premise, hypothesis, label) data preparation and scoring on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers are sent by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
