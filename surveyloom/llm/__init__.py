"""Operators of a training-data pipeline.

Functions of this package travel to the executors with the job itself, so tasks
need no installed copy of it.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

register_pickle_by_value(sys.modules[__name__])
