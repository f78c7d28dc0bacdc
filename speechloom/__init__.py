"""Speech-annotation and token-corpus analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions sent to executors carry their code, so workers need not find this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
