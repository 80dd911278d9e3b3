"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.

The functions that run in tasks are sent to the executors by value, with all
that they use from here, so the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
