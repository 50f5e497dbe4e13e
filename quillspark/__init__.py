"""quillspark: a PySpark-native text retrieval, mining and corpus-processing engine."""

import sys

from pyspark import cloudpickle

# Workers need no copy of the package on their path: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
