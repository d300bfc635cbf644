"""Registered source/sink queries (A1, A6-A8, A10). Each writes a table
Spark derives from the driver tables into the shared folder and reads it
back through the loader."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from quarry.plans import derived as D
from quarry.plans.catalog import query
from quarry.plans.q_cluster import _FIXED_SQL, _fixed
from quarry.session import checkpoint_dir
from quarry.sources import csv as IO
from quarry.sources import sinks as SK
from quarry.sources.tables import read_table


def _out(spark, name):
    return os.path.join(checkpoint_dir(spark), "exports", f"{name}-{uuid.uuid4().hex}.csv")


@query("a1_csv_sniff_roundtrip", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def a1_csv_sniff_roundtrip(spark, sf):
    """customer written with ';' and read back with delimiter sniffing."""
    p = SK.write_csv(read_table(spark, sf, "customer"), _out(spark, "customer"), sep=";")
    d = IO.load_file(spark, p)
    return d.select(F.col("c_custkey").cast("bigint"), "c_name",
                    F.col("c_nationkey").cast("bigint"), F.col("c_acctbal").cast("double"),
                    "c_mktsegment")


@query("a6_csv_export", """
SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_returnflag FROM lineitem""")
def a6_csv_export(spark, sf):
    li = read_table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity",
                                                  "l_extendedprice", "l_returnflag")
    p = SK.write_csv(li, _out(spark, "lineitem"))
    d = IO.load_file(spark, p)
    return d.select(F.col("l_orderkey").cast("bigint"), F.col("l_linenumber").cast("int"),
                    F.col("l_quantity").cast("double"), F.col("l_extendedprice").cast("double"),
                    "l_returnflag")


@query("a10_export_with_clusters", _FIXED_SQL + "\nSELECT vec_id, label, cluster FROM asg")
def a10_export_with_clusters(spark, sf):
    """Original rows + cluster labels (already a column, no positional zip)."""
    a = _fixed(spark, sf).select("vec_id", "label", "cluster")
    p = SK.write_csv(a, _out(spark, "clusters"))
    d = IO.load_file(spark, p)
    return d.select(F.col("vec_id").cast("bigint"), F.col("label").cast("bigint"),
                    F.col("cluster").cast("bigint"))


@query("a7_report_tables")
def a7_report_tables(spark, sf):
    from quarry.operators import profile as P
    from quarry.plans.q_metrics import _results
    from quarry.plans.q_split import _orders_split
    from quarry.operators import split as S
    tables = {
        "dataset_info": P.dataset_shape(D.orders_wide(spark, sf)),
        "model_comparison": _results(spark, sf, "val"),
        "test_metrics": _results(spark, sf, "test"),
        "descriptive_statistics": P.describe(read_table(spark, sf, "lineitem")),
        "split_sizes": S.split_sizes(_orders_split(spark, sf)),
    }
    return SK.write_report(tables, os.path.join(checkpoint_dir(spark), "exports",
                                                f"report-{uuid.uuid4().hex}"))


@query("a8_run_summary")
def a8_run_summary(spark, sf):
    from quarry.plans.q_metrics import _results
    res = _results(spark, sf, "val")
    n = D.scored(spark, sf).count()
    s = SK.run_summary(spark, {"table": "scored", "n_rows": n},
                       {"num_impute": "median", "scaler": "standard", "encoder": "onehot"},
                       models=res, final_test=_results(spark, sf, "test"))
    p = SK.write_json(s, os.path.join(checkpoint_dir(spark), "exports", f"summary-{uuid.uuid4().hex}"))
    return spark.read.json(p)


@query("a2_latin1_roundtrip", r"""
SELECT doc_id, lang, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents""")
def a2_latin1_roundtrip(spark, sf):
    """documents written in ISO-8859-1 (one line per row) and read back: the
    loader detects invalid UTF-8 and falls back to Latin-1."""
    d = read_table(spark, sf, "documents").select(
        "doc_id", "lang", "source", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text"))
    p = SK.write_csv(d, _out(spark, "documents-latin1"), encoding="ISO-8859-1")
    r = IO.load_file(spark, p)
    return r.select(F.col("doc_id").cast("bigint"), "lang", "source", "text")


@query("a2_documents_roundtrip", "SELECT doc_id, lang, source, text, n_chars FROM documents")
def a2_documents_roundtrip(spark, sf):
    """documents with their line breaks and quotes, written as UTF-8 CSV and read
    back block by block."""
    d = read_table(spark, sf, "documents").select("doc_id", "lang", "source", "text", "n_chars")
    return IO.load_file(spark, SK.write_csv(d, _out(spark, "documents-utf8"))).select(
        F.col("doc_id").cast("bigint"), "lang", "source", "text", F.col("n_chars").cast("bigint"))


@query("a3_strip_column_names", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def a3_strip_column_names(spark, sf):
    """customer written with space-padded header names, loaded with names stripped."""
    c = read_table(spark, sf, "customer")
    padded = c.toDF(*[f"  {n} " for n in c.columns])
    p = SK.write_csv(padded, _out(spark, "customer-padded"))
    d = IO.load_file(spark, p)
    return d.select(F.col("c_custkey").cast("bigint"), "c_name",
                    F.col("c_nationkey").cast("bigint"), F.col("c_acctbal").cast("double"),
                    "c_mktsegment")


@query("a5_load_errors")
def a5_load_errors(spark, sf):
    """Typed load errors: an unsupported extension and a table with no rows
    (customer rows whose every value is NULL – none – after A4)."""
    out = []
    c = read_table(spark, sf, "customer")
    p = SK.write_csv(c, _out(spark, "customer").replace(".csv", ".xlsx"))
    try:
        IO.load_file(spark, p)
        out.append(("unsupported_extension", None))
    except IO.LoadError as e:
        out.append(("unsupported_extension", str(e)))
    nulls = c.select(*[F.lit(None).cast(t).alias(n) for n, t in c.dtypes])
    p2 = SK.write_csv(nulls, _out(spark, "customer-nulls"))
    try:
        IO.load_file(spark, p2)
        out.append(("empty_table", None))
    except IO.LoadError as e:
        out.append(("empty_table", str(e)))
    return spark.createDataFrame(out, "case string, error string")
