"""Registered profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import profile as P
from quarry.plans import derived as D
from quarry.plans.catalog import query
from quarry.plans.sqlgen import (describe_sql, null_profile_sql, numeric_summary_sql,
                                 profile_sql, value_counts_sql)
from quarry.sources.tables import read_table

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                "l_extendedprice", "l_discount", "l_tax"]
DOC_LABELLED_COLS = [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                     ("source", "string"), ("n_chars", "bigint"), ("quality", "int"),
                     ("toxic", "int")]
ORDERS_WIDE_COLS = [("o_orderkey", "bigint"), ("o_totalprice", "double"),
                    ("c_acctbal", "double"), ("ret_qty", "double"),
                    ("o_orderpriority", "string"), ("c_mktsegment", "string"),
                    ("ret_status", "string"), ("o_orderstatus", "string")]
EVENTS_STR_COLS = [("event_id", "bigint"), ("k_str", "string"), ("value_str", "string"),
                   ("ts_str", "string"), ("value_or_na", "string"), ("event_type", "string"),
                   ("props", "string")]
ORDERS_WIDE_NUM = ["o_orderkey", "o_totalprice", "c_acctbal", "ret_qty"]
ORDERS_WIDE_CAT = ["o_orderpriority", "c_mktsegment", "ret_status", "o_orderstatus"]
W = D.with_sql


# --- B10 describe ----------------------------------------------------------------

@query("b10_describe_lineitem", describe_sql("lineitem", LINEITEM_NUM))
def b10_describe_lineitem(spark, sf):
    return P.describe(read_table(spark, sf, "lineitem"), LINEITEM_NUM)


@query("b10_describe_rank_method", describe_sql("lineitem", ["l_quantity", "l_extendedprice"]))
def b10_describe_rank_method(spark, sf):
    """Same statistics through the memory-bounded rank quantile route."""
    return P.describe(read_table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"],
                      method="rank")


@query("b10_describe_bracket_method", describe_sql("lineitem", LINEITEM_NUM))
def b10_describe_bracket_method(spark, sf):
    """Same statistics through the bracket quantile route (the route every
    column with more than a million distinct values takes)."""
    return P.describe(read_table(spark, sf, "lineitem"), LINEITEM_NUM, method="bracket")


# --- B8 numeric summary ---------------------------------------------------------------

@query("b8_numeric_summary",
       W("orders_wide") + numeric_summary_sql("orders_wide", ORDERS_WIDE_NUM))
def b8_numeric_summary(spark, sf):
    return P.numeric_summary(D.orders_wide(spark, sf), ORDERS_WIDE_NUM)


# --- B9 categorical summary ----------------------------------------------------------

_B9_SQL = W("orders_wide") + f"""
, vc AS ({value_counts_sql('orders_wide', ORDERS_WIDE_CAT)})
, ranked AS (SELECT *, row_number() OVER (PARTITION BY variable ORDER BY count DESC, value) AS rank FROM vc)
, m AS (SELECT variable, value AS mode FROM ranked WHERE rank = 1)
SELECT r.variable, r.value, r.count, CAST(r.rank AS INTEGER) AS rank, m.mode
FROM ranked r JOIN m ON r.variable = m.variable WHERE r.rank <= 5"""


@query("b9_categorical_summary", _B9_SQL)
def b9_categorical_summary(spark, sf):
    return P.categorical_summary(D.orders_wide(spark, sf), ORDERS_WIDE_CAT)


# --- B4 null profile / B15 null ranking ------------------------------------------

@query("b4_null_profile",
       W("orders_wide") + null_profile_sql("orders_wide", [c for c, _ in ORDERS_WIDE_COLS]))
def b4_null_profile(spark, sf):
    return P.null_profile(D.orders_wide(spark, sf))


@query("b15_null_ranking", W("doc_labelled") + f"""
, p AS ({null_profile_sql('doc_labelled', [c for c, _ in DOC_LABELLED_COLS])})
SELECT column_name, n_null, null_pct,
  CASE WHEN null_pct > 50 THEN 'drop_column' WHEN null_pct > 20 THEN 'impute_median_mode_or_model'
       ELSE 'impute_simple' END AS action,
  CAST(dense_rank() OVER (ORDER BY n_null DESC, column_name) AS INTEGER) AS rank
FROM p WHERE n_null > 0""")
def b15_null_ranking(spark, sf):
    return P.null_ranking(D.doc_labelled(spark, sf))


# --- B3 roles, B2 dates, B5 targets, B6 ML-usable, B11 catalogue -----------------------

def _roles_ctes(table, cols):
    return f"""
, p AS ({profile_sql(table, cols)})
, r AS (SELECT column_name, dtype, n_valid, n_unique, date_ratio, role,
  ((role = 'categorical' AND n_unique >= 2 AND n_unique <= 20) OR (role = 'numeric' AND n_unique <= 20)) AS candidate_target,
  n_unique >= 2 AS has_two_values,
  role IN ('numeric', 'categorical') AS ml_usable
FROM p)
"""


def _roles_sql(table, cols):
    return _roles_ctes(table, cols) + "SELECT * FROM r"


@query("b3_roles_events_str", W("events_str") + _roles_sql("events_str", EVENTS_STR_COLS))
def b3_roles_events_str(spark, sf):
    return P.column_roles(D.events_str(spark, sf))


@query("b3_roles_doc_labelled", W("doc_labelled") + _roles_sql("doc_labelled", DOC_LABELLED_COLS))
def b3_roles_doc_labelled(spark, sf):
    return P.column_roles(D.doc_labelled(spark, sf))


@query("b3_roles_orders_wide", W("orders_wide") + _roles_sql("orders_wide", ORDERS_WIDE_COLS))
def b3_roles_orders_wide(spark, sf):
    return P.column_roles(D.orders_wide(spark, sf))


@query("b2_datetime_detection", W("events_str") + f"""
, p AS ({profile_sql('events_str', EVENTS_STR_COLS)})
SELECT column_name, date_ratio, role = 'datetime' AS is_datetime FROM p""")
def b2_datetime_detection(spark, sf):
    return (P.profile_columns(D.events_str(spark, sf))
            .select("column_name", "date_ratio", (F.col("role") == "datetime").alias("is_datetime")))


@query("b5_candidate_targets", W("orders_wide") + _roles_ctes('orders_wide', ORDERS_WIDE_COLS) + f"""
SELECT column_name, role, n_unique, has_two_values FROM r WHERE candidate_target""")
def b5_candidate_targets(spark, sf):
    return (P.column_roles(D.orders_wide(spark, sf)).where("candidate_target")
            .select("column_name", "role", "n_unique", "has_two_values"))


@query("b6_ml_usable", W("doc_labelled") + _roles_ctes('doc_labelled', DOC_LABELLED_COLS) + f"""
SELECT column_name, role FROM r WHERE ml_usable""")
def b6_ml_usable(spark, sf):
    return (P.column_roles(D.doc_labelled(spark, sf)).where("ml_usable")
            .select("column_name", "role"))


@query("b11_column_catalogue", W("doc_labelled") + f"""
, p AS ({profile_sql('doc_labelled', DOC_LABELLED_COLS)})
SELECT position, column_name, role, dtype, n_null, null_pct, n_unique FROM p""")
def b11_column_catalogue(spark, sf):
    return P.column_catalogue(D.doc_labelled(spark, sf))


# --- B7 / B13 shape and completeness -----------------------------------------------

@query("b7_dataset_shape", W("doc_labelled") + f"""
, p AS ({profile_sql('doc_labelled', DOC_LABELLED_COLS)})
SELECT max(n_rows) AS n_rows, count(*) AS n_cols,
  count(CASE WHEN role = 'numeric' THEN 1 END) AS n_numeric,
  count(CASE WHEN role = 'categorical' THEN 1 END) AS n_categorical,
  count(CASE WHEN role = 'datetime' THEN 1 END) AS n_datetime,
  count(CASE WHEN role = 'text' THEN 1 END) AS n_text,
  count(CASE WHEN role = 'id_like' THEN 1 END) AS n_id_like,
  CAST(sum(n_null) AS BIGINT) AS n_null_cells,
  round(CASE WHEN max(n_rows) * count(*) > 0 THEN (1 - sum(n_null) / (max(n_rows) * count(*))) * 100 END, 1) AS completeness_pct
FROM p""")
def b7_dataset_shape(spark, sf):
    return P.dataset_shape(D.doc_labelled(spark, sf))


# --- B1 numeric strings ------------------------------------------------------------

_EV_STR = [c for c, t in EVENTS_STR_COLS if t == "string"]


def _shares_sql():
    parts = [f"SELECT '{c}' AS column_name, CAST(count(TRY_CAST({c} AS DOUBLE)) AS DOUBLE) / count(*) AS parse_share FROM events_str"
             for c in _EV_STR]
    return "(" + " UNION ALL ".join(parts) + ")"


@query("b1_numeric_string_shares", W("events_str") + f"""
SELECT column_name, parse_share, coalesce(parse_share > 0.8, FALSE) AS converted FROM {_shares_sql()} s""")
def b1_numeric_string_shares(spark, sf):
    return P.numeric_string_shares(D.events_str(spark, sf))


@query("b1_convert_numeric_strings", W("events_str") + """
SELECT event_id, TRY_CAST(k_str AS DOUBLE) AS k_str, TRY_CAST(value_str AS DOUBLE) AS value_str,
       ts_str, value_or_na, event_type, props FROM events_str""")
def b1_convert_numeric_strings(spark, sf):
    return P.convert_numeric_strings(D.events_str(spark, sf))


# --- B12 duplicates ---------------------------------------------------------------

@query("b12_duplicates_documents", """
SELECT count(*) AS n_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents) d) AS n_duplicates
FROM documents""")
def b12_duplicates_documents(spark, sf):
    return P.duplicate_rows(read_table(spark, sf, "documents").select("text", "lang", "source"))


@query("b12_duplicates_lineitem", """
SELECT count(*) AS n_rows,
       count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_discount, l_tax FROM lineitem) d) AS n_duplicates
FROM lineitem""")
def b12_duplicates_lineitem(spark, sf):
    return P.duplicate_rows(read_table(spark, sf, "lineitem")
                            .select("l_returnflag", "l_linestatus", "l_discount", "l_tax"))


# --- A3 / A4 / A11 ---------------------------------------------------------------

@query("a4_drop_empty_rows", W("doc_labelled") + """
SELECT count(*) AS n_rows FROM (
  SELECT quality, toxic FROM doc_labelled WHERE quality IS NOT NULL OR toxic IS NOT NULL) t""")
def a4_drop_empty_rows(spark, sf):
    """Rows of (quality, toxic) left after dropping all-NULL rows."""
    t = D.doc_labelled(spark, sf).select("quality", "toxic")
    return P.drop_empty_rows(t).agg(F.count(F.lit(1)).alias("n_rows"))


@query("a11_preview", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
FROM orders ORDER BY o_orderkey LIMIT 10""")
def a11_preview(spark, sf):
    """Deterministic head(n): TakeOrdered keeps n rows per task, then merges."""
    return (read_table(spark, sf, "orders")
            .select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")
            .orderBy("o_orderkey").limit(10))


@query("b13_completeness", W("orders_wide") + f"""
, p AS ({null_profile_sql('orders_wide', [c for c, _ in ORDERS_WIDE_COLS])})
SELECT (SELECT count(*) FROM orders_wide) AS n_rows, count(*) AS n_cols, CAST(sum(n_null) AS BIGINT) AS n_null_cells,
  round((1 - sum(n_null) / ((SELECT count(*) FROM orders_wide) * count(*))) * 100, 1) AS completeness_pct
FROM p""")
def b13_completeness(spark, sf):
    return P.dataset_shape(D.orders_wide(spark, sf)).select(
        "n_rows", "n_cols", "n_null_cells", "completeness_pct")
