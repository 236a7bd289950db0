"""Operators for preparing large text corpora, as Spark jobs."""

import sys

from pyspark import cloudpickle

# tasks get the functions themselves, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
