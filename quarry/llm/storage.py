"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names.

A written table cuts the lineage like ``checkpoint()`` does, but keeps its
columns apart, so later steps read only the ones they need. Every executor
sees the folder; losing one loses nothing.

``every_pair`` sets all rows of such a table beside all rows of another one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from quarry.session import checkpoint_dir


class Stage:
    """Intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{checkpoint_dir(spark).rstrip('/')}/quarry-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the table read back (same schema)."""
        self.n += 1
        path = f"{self.base}/t{self.n}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self) -> None:
        """Delete the tables; call it only when no result reads them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.base)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def every_pair(kept: DataFrame, n: int, number: str, asked: DataFrame) -> DataFrame:
    """Each row of ``kept`` (``n`` numbers, ``number`` and ``width`` name a row)
    beside each row of ``asked`` of its width; both are written tables.

    A task streams a part of ``kept`` and reads a split of ``asked`` for itself.
    Rows that are large but few are told as small by Spark's estimates; so the
    hint keeps both sides from being broadcast through the driver, and ``asked``
    is neither copied for each row of ``kept`` nor exchanged. The rows of ``asked``
    that meet one row of ``kept`` come one after the other.
    """
    parts = min(n, int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return kept.repartition(parts, "width", number).hint("shuffle_replicate_nl").join(asked, "width")
