"""A PySpark engine for the logs of AI-agent tool calls.

Functions of this package that run in tasks are sent by value, so executors need
no copy of it; ``--py-files`` works as well.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
