"""Infrastructure-metrics analytics as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry their code, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
