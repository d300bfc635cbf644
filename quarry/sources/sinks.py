"""Sinks: CSV export, multi-table report, JSON run summary.

Every writer is a distributed ``DataFrame.write``: no table is pulled
through the driver. Paths live in the shared folder the caller names (on a
cluster: ``spark.checkpoint.dir`` or a warehouse location).
"""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8") -> str:
    """Header, no index column; one part file per task."""
    (df.write.mode("overwrite").option("header", True).option("sep", sep)
       .option("encoding", encoding).option("escape", '"')
       .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))
    return path


def write_report(tables: Mapping[str, DataFrame], path: str, fmt: str = "parquet") -> DataFrame:
    """One dataset per report table under ``path/<name>`` (the
    workbook's sheets re-aimed); returns (table, n_rows, path)."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in tables.items():
        p = os.path.join(path, name)
        w = df.write.mode("overwrite")
        (w.option("header", True).option("escape", '"').csv(p) if fmt == "csv" else w.parquet(p))
        rd = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(p) if fmt == "csv" else spark.read.parquet(p)
        rows.append((name, rd.count(), p))
    return spark.createDataFrame(rows, "table string, n_rows long, path string")


def run_summary(spark: SparkSession, dataset: Mapping, preprocessing: Mapping,
                models: DataFrame | None = None, final_test: DataFrame | None = None,
                clustering: Mapping | None = None) -> DataFrame:
    """One-row nested summary (dataset, preprocessing, models,
    final_test, clustering). The model and test tables are small result
    tables (one row per model / metric)."""
    def js(x):
        return json.dumps(x, default=float, sort_keys=True)
    base = spark.range(1).select(
        F.from_json(F.lit(js(dict(dataset))), "map<string,string>").alias("dataset"),
        F.from_json(F.lit(js(dict(preprocessing))), "map<string,string>").alias("preprocessing"),
        F.from_json(F.lit(js(dict(clustering or {}))), "map<string,string>").alias("clustering"))
    if models is not None:
        m = models.agg(F.collect_list(F.struct(*models.columns)).alias("models"))
        base = base.withColumn("_k", F.lit(1)).join(m.withColumn("_k", F.lit(1)), "_k").drop("_k")
    if final_test is not None:
        t = final_test.agg(F.collect_list(F.struct(*final_test.columns)).alias("final_test"))
        base = base.withColumn("_k", F.lit(1)).join(t.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return base


def write_json(df: DataFrame, path: str) -> str:
    df.coalesce(1).write.mode("overwrite").json(path)  # one summary row
    return path
