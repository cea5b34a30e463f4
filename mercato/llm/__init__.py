"""Operators for building language-model training data.

Every module here is a self-contained operator; nothing else in ``mercato``
imports this package.  Functions that run inside Python workers are shipped
by value, so executors need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
