"""Spark operators for event-triggered sensor telemetry."""

import sys

from pyspark import cloudpickle

# Python steps run on executors; ship them with the plan so that workers need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
