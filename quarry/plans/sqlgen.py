"""SQL twins (DuckDB dialect) for the profiling operators.

These generate the *oracle* text the driver runs in DuckDB; they are not
used to execute anything in Spark.
"""

from __future__ import annotations

from collections.abc import Sequence

from quarry.operators.profile import (DATE_NAME_HINTS, DATE_RATIO, DATE_RATIO_HINTED,
                                      ID_LIKE_MIN_ROWS, MAX_CATEGORICAL_RATIO,
                                      MAX_CATEGORICAL_UNIQUE)

NUMERIC_TYPES = {"tinyint", "smallint", "int", "bigint", "float", "double", "boolean"}
INT_TYPES = {"tinyint", "smallint", "int", "bigint"}
DT_TYPES = {"date", "timestamp", "timestamp_ntz"}


def q(c: str) -> str:
    return '"' + c.replace('"', '""') + '"'


def r4(expr: str, dp: int = 4) -> str:
    # "+ 0.0" turns a rounded -0.0 into 0.0, as Spark's decimal rounding does
    return f"(round(CAST({expr} AS DOUBLE), {dp}) + 0.0)"


def profile_sql(table: str, cols: Sequence[tuple[str, str]]) -> str:
    """Per-column facts + role, mirroring ``profile_columns``.

    ``cols`` = [(name, spark simpleString dtype)] in table order.
    """
    parts = []
    for i, (c, dt) in enumerate(cols):
        qc = q(c)
        is_str = dt == "string"
        hint = any(h in c.lower() for h in DATE_NAME_HINTS)
        n_date = (f"count(CASE WHEN regexp_matches({qc}, '[-/:]') AND TRY_CAST({qc} AS TIMESTAMP)"
                  f" IS NOT NULL THEN 1 END)") if is_str else "CAST(NULL AS BIGINT)"
        n_num = (f"count(TRY_CAST({qc} AS DOUBLE))" if is_str else "CAST(NULL AS BIGINT)")
        uniq = f"count(DISTINCT {qc})" if is_str else f"count(DISTINCT CAST({qc} AS VARCHAR))"
        parts.append(
            f"SELECT {i} AS position, '{c}' AS column_name, '{dt}' AS dtype, count(*) AS n_rows, "
            f"count({qc}) AS n_valid, {n_date} AS n_date, {n_num} AS n_numstr, "
            f"{uniq} AS n_unique, {str(dt in NUMERIC_TYPES).upper()} AS is_num, "
            f"{str(dt in INT_TYPES).upper()} AS is_int, {str(dt in DT_TYPES).upper()} AS is_dt, "
            f"{str(is_str).upper()} AS is_str, {str(hint).upper()} AS name_hint FROM {table}")
    facts = "\nUNION ALL\n".join(parts)
    date_ratio = "CASE WHEN is_str AND n_valid > 0 THEN n_date / n_valid END"
    return f"""
SELECT position, column_name, dtype, n_rows, n_valid, n_rows - n_valid AS n_null,
  round(CASE WHEN n_rows > 0 THEN CAST(n_rows - n_valid AS DOUBLE) * 100 / n_rows END, 2) AS null_pct,
  n_unique, round({date_ratio}, 4) AS date_ratio,
  (n_numstr = n_valid) AS all_numeric,
  CASE WHEN n_valid = 0 THEN 'empty'
       WHEN coalesce(is_dt OR (is_str AND (({date_ratio}) > {DATE_RATIO} OR (name_hint AND ({date_ratio}) > {DATE_RATIO_HINTED}))), FALSE) THEN 'datetime'
       WHEN is_num AND is_int AND n_unique = n_valid AND n_valid > {ID_LIKE_MIN_ROWS} THEN 'id_like'
       WHEN is_num THEN 'numeric'
       WHEN n_unique <= {MAX_CATEGORICAL_UNIQUE} OR n_unique / n_valid <= {MAX_CATEGORICAL_RATIO} THEN 'categorical'
       WHEN n_numstr = n_valid THEN 'numeric'
       ELSE 'text' END AS role
FROM ({facts}) f"""


def describe_sql(table: str, cols: Sequence[str]) -> str:
    parts = []
    for c in cols:
        qc = q(c)
        parts.append(
            f"SELECT '{c}' AS variable, count({qc}) AS count, {r4(f'avg({qc})')} AS mean, "
            f"{r4(f'stddev_samp({qc})')} AS std, {r4(f'min({qc})')} AS min, "
            f"{r4(f'quantile_cont({qc}, 0.25)')} AS q25, {r4(f'quantile_cont({qc}, 0.5)')} AS q50, "
            f"{r4(f'quantile_cont({qc}, 0.75)')} AS q75, {r4(f'max({qc})')} AS max FROM {table}")
    return "\nUNION ALL\n".join(parts)


def numeric_summary_sql(table: str, cols: Sequence[str]) -> str:
    parts = []
    for c in cols:
        qc = q(c)
        x = f"CAST({qc} AS DOUBLE)"
        parts.append(
            f"SELECT '{c}' AS variable, count(*) AS n_total, count({qc}) AS n_valid, "
            f"count(*) - count({qc}) AS n_null, "
            f"round(CAST(count(*) - count({qc}) AS DOUBLE) * 100 / count(*), 2) AS null_pct, "
            f"count(DISTINCT {qc}) AS n_unique, "
            f"round(CASE WHEN count({qc}) > 0 THEN CAST(count(DISTINCT {qc}) AS DOUBLE) * 100 / count({qc}) ELSE 0 END, 2) AS unique_pct, "
            f"{r4(f'avg({x})')} AS mean, {r4(f'stddev_samp({x})')} AS std, {r4(f'min({x})')} AS min, "
            f"{r4(f'quantile_cont({x}, 0.25)')} AS q25, {r4(f'quantile_cont({x}, 0.5)')} AS median, "
            f"{r4(f'quantile_cont({x}, 0.75)')} AS q75, {r4(f'max({x})')} AS max, "
            f"{r4(f'CASE WHEN count({x}) < 3 THEN NULL WHEN stddev_pop({x}) = 0 THEN 0 ELSE skewness({x}) END')} AS skew, "
            f"{r4(f'CASE WHEN count({x}) < 4 THEN NULL WHEN stddev_pop({x}) = 0 THEN 0 ELSE kurtosis({x}) END')} AS kurt "
            f"FROM {table}")
    return "\nUNION ALL\n".join(parts)


def null_profile_sql(table: str, cols: Sequence[str]) -> str:
    parts = []
    for c in cols:
        qc = q(c)
        nn = f"count(*) - count({qc})"
        parts.append(
            f"SELECT '{c}' AS column_name, {nn} AS n_null, "
            f"round(CASE WHEN count(*) > 0 THEN CAST({nn} AS DOUBLE) * 100 / count(*) END, 2) AS null_pct, "
            f"({nn}) > 0 AS has_nulls FROM {table}")
    return "\nUNION ALL\n".join(parts)


def value_counts_sql(table: str, cols: Sequence[str]) -> str:
    parts = [f"SELECT '{c}' AS variable, CAST({q(c)} AS VARCHAR) AS value FROM {table} "
             f"WHERE {q(c)} IS NOT NULL" for c in cols]
    return ("SELECT variable, value, count(*) AS count FROM (" + " UNION ALL ".join(parts)
            + ") u GROUP BY variable, value")
