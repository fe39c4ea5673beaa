"""Telemetry analytics and text-corpus operators as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions for executors travel with their code, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
