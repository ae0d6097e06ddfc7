"""PySpark-native engine for 3D city models."""

import sys

from pyspark import cloudpickle

# Functions that run on executors are sent with the modules that they use: workers needn't have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
