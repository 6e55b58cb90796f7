"""tarn: a Spark-native analytics engine for record and text corpora."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel with their jobs, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
