"""Credit-default scoring, validation and approval analytics on PySpark."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job, so workers need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
