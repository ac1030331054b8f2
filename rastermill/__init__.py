"""Raster-to-vector analytics, service metadata queries and corpus preparation as Spark jobs.

Functions that run inside Python workers travel by value, so that executors need no copy of this
package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
