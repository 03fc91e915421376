"""wavegrid: frequency-domain and time-frequency analysis of image time series on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so that the package need not be
# installed on every node.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
