"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its
queries only when the folder exists.
"""

import sys

from pyspark import cloudpickle

# Executors may not have this package on their path: ship its functions by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
