"""Half-hourly meter panel analytics on Spark DataFrames."""
import sys

from pyspark import cloudpickle

from .session import build_session, configure, durable

__all__ = ["build_session", "configure", "durable"]

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
