"""Gridloom: delimited-file ingest, duplicates, compare, join, browse, SQL and export on PySpark."""

import sys

from pyspark import cloudpickle

# The few functions that run on executors travel with their tasks; workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
