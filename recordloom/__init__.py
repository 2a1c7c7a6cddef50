"""Business-record analytics and corpus preparation on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python tasks travel with their task, so executors
# need Spark's own dependencies only, not an installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
