"""quarry: tabular profiling, preparation, segmentation and classification on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
expressions and Spark ML; none collects an unbounded amount of data to the
driver. Row alignment is always by an explicit key column, never by position.
"""

import sys

from pyspark import cloudpickle

from quarry.session import get_spark, checkpoint_dir  # noqa: F401

# functions travel to the executors by value: a worker needs no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
