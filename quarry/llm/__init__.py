"""Training-data operators: thirteen numbered operators, their queries and SQL.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its
queries when it is present. Its functions travel to the executors by value,
so a worker needs no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
