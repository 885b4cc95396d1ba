"""A layered transaction warehouse expressed as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

from ledgerloom.session import configure, stage, workspace

__all__ = ["configure", "stage", "workspace"]

# Task functions travel with their job; workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
