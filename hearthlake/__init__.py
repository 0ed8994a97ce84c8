"""A PySpark-native analytics engine for property-market data."""

import sys

from pyspark import cloudpickle

# Functions that run inside tasks travel with the job; executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
