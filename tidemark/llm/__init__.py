"""Training-data operators: ten stages of a text corpus pipeline, one module each.

Nothing outside this subpackage imports it; ``queries`` lists the registered queries.
"""

import sys

from pyspark import cloudpickle

# Functions of this subpackage travel to executors by value: a worker needs no copy of the repository.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
