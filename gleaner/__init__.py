"""Corpus analytics on Spark: records, facts, arms, collections, vectors and syncs as DataFrames."""

import sys

from pyspark import cloudpickle

# task functions travel with the job, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
