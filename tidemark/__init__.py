"""A PySpark-native engine for entity-by-period panels, risk monitoring and training-data preparation.

Functions that run on executors are shipped by value, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
