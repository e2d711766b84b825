"""Geospatial search, enrichment and least-cost routing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions of the package travel to executors by value: these need not have it on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
