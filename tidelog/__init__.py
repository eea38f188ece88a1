"""Change-data-capture analytics as Spark DataFrame transformations."""

import sys

from pyspark import cloudpickle

from tidelog.session import build_session, configure, small_table

# Executors need not have this package: functions sent to them travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "configure", "small_table"]
