"""lakequill: relational, time-series and JSON queries as plain Spark plans.

Functions of this package that run inside Python workers travel by value, so a
cluster needs the package on the driver only.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
