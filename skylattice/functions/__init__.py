"""Part of the engine; see the README. What tasks run of it is sent to them by value, so
executors needn't have the package."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
