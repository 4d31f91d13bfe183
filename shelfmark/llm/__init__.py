"""Operators for building training corpora. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors get the operators' code with each task, so they need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules["shelfmark"])
