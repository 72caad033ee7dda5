"""Operators for preparing training text. Nothing else in the library imports this package."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so the cluster needs no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
