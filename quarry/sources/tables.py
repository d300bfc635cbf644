"""Parquet table access.

Reads are lazy: Catalyst prunes columns and pushes filters into the Parquet
scan, so callers select only what they need.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from quarry.functions.stats import nan_to_null

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

DEFAULT_SF_DIR = "/root/testdata/sf0.01"


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Lazy parquet scan of a driver table, float NaN read as NULL. The plan is
    the same at every size: no repartition, no look at files on the driver."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return nan_to_null(spark.read.parquet(table_path(sf_dir, name)))


def stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as a streaming source with ``read_table``'s schema. The table
    may be a folder of part files, also partitioned ones, or one file: a stream
    takes no plain path of a file, so that one is filtered by name in ``sf_dir``.
    No path is a glob: Hadoop's globs take no colon in the names around them."""
    source = spark.readStream.schema(read_table(spark, sf_dir, name).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(table_path(sf_dir, name))
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return nan_to_null(source.parquet(table_path(sf_dir, name)))
    return nan_to_null(source.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir))
