"""workfeed: feeds of dated work items as Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: functions that run in Python
# workers travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
