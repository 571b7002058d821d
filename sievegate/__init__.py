"""sievegate: governed document retrieval and analytics as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so that executors do not
# need this package installed. They use no other module of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
