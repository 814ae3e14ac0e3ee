"""Training-data operators: one module each, plus ``registry`` for the queries.

Python functions that run on executors are shipped by value, so executors need
not have this package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
