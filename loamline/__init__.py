"""loamline: keyed tables, reports, order books and message processing on the Spark DataFrame API.

Functions sent to executors travel by value, so a cluster needs no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
