"""Security analytics for payment and API telemetry on Spark, and operators that prepare training data at scale."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: functions that run in Python workers travel with their tasks.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
