"""Snapshot analytics on PySpark: DataFrame operators over records, entries, chunks and catalog logs."""

import sys

from pyspark import cloudpickle

#: Functions that run on executors travel inside the task, so a cluster needs no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
