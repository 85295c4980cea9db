"""Operators for preparing language-model training data. Nothing else in the package imports this folder."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this folder with the tasks, so it need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
