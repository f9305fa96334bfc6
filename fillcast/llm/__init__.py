"""Operators for cleaning, deduplicating, filtering and mixing text corpora."""

import sys

from pyspark import cloudpickle

# Executors need not have the package installed: functions of its modules travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
