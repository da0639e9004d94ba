"""Operators for building language-model training data.

Their task functions travel to the executors by value, so a cluster needs only the public
libraries on its nodes, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
