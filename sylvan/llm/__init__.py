"""Operators of a large-scale training-data pipeline.

Functions of this package are sent to the executors by value, so a cluster
needs no copy of it; numpy, pyarrow and the named libraries must be there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
