"""Cohort audits and signature transfer on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel with their code, so executors need no install
cloudpickle.register_pickle_by_value(sys.modules[__name__])
