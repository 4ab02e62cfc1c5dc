"""Multi-modal feature-table analytics on PySpark."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Task functions travel with the job, so executors need no installed copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
