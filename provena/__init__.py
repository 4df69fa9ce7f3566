"""Provenance and quality checks over text corpora, written as Spark jobs."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the job, so the workers need
# not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
