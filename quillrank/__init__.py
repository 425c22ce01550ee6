"""Retrieval analytics on Spark: chunking, ranked search, label joins, metrics."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their code, so that a session whose
# workers cannot import this package still runs them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
