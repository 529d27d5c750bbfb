"""Text sentiment, price and calendar-event analytics as PySpark DataFrame functions."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions shipped to executors travel with their code: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
