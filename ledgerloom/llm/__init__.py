"""Operators of a training-data pipeline over whole tables. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Workers get these functions by value: an executor needs no copy of the package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
