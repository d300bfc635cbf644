import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from quarry.session import get_spark
    s = SparkSession.getActiveSession() or get_spark("local[4]", shuffle_partitions=4)
    yield s


SF001 = "/root/testdata/sf0.001"
