"""Spark-native analytics over IoT message traffic (MQTT and CoAP)."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions travel by value with the plan, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
