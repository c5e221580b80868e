"""Spark-native analytics for fleets of electrical power meters."""

import sys

from pyspark import cloudpickle

from gridlens.config import DEFAULTS, Settings
from gridlens.session import tune

__all__ = ["DEFAULTS", "Settings", "tune"]

# Batch functions travel to the executors with their code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
