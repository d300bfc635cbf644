"""Registered distribution / correlation / insight queries."""

from __future__ import annotations

from quarry.functions.hashing import seeded_order_sql
from quarry.operators import distrib as X
from quarry.plans import derived as D
from quarry.plans.catalog import query
from quarry.plans.q_profile import DOC_LABELLED_COLS, LINEITEM_NUM
from quarry.plans.sqlgen import null_profile_sql, q, r4
from quarry.sources.tables import read_table

W = D.with_sql


# --- B16 null map ----------------------------------------------------------------

def _null_map_sql():
    cols = [c for c, _ in DOC_LABELLED_COLS if c != "doc_id"]
    parts = [f"SELECT doc_id AS row_key, '{c}' AS column_name, CAST({q(c)} IS NULL AS INTEGER) AS is_null FROM head"
             for c in cols]
    return (W("doc_labelled") + ", head AS (SELECT * FROM doc_labelled ORDER BY doc_id LIMIT 200)\n"
            + "\nUNION ALL\n".join(parts))


@query("b16_null_map", _null_map_sql())
def b16_null_map(spark, sf):
    return X.null_map(D.doc_labelled(spark, sf), "doc_id", 200)


# --- B17 outliers ---------------------------------------------------------------

def _outliers_sql(table, cols):
    parts = []
    for c in cols:
        x = f"CAST({q(c)} AS DOUBLE)"
        parts.append(f"""SELECT '{c}' AS variable, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf,
  q1, q3 FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {table})""")
    fences = "\nUNION ALL\n".join(parts)
    aggs = []
    for c in cols:
        x = f"CAST({q(c)} AS DOUBLE)"
        aggs.append(f"""SELECT f.variable, count(CASE WHEN {x} < f.lf OR {x} > f.uf THEN 1 END) AS n_outliers,
  round(CAST(count(CASE WHEN {x} < f.lf OR {x} > f.uf THEN 1 END) AS DOUBLE) * 100 / count({x}), 2) AS pct_outliers,
  round(f.lf, 4) AS lower, round(f.uf, 4) AS upper, {r4(f'min({x})')} AS min, {r4(f'max({x})')} AS max
FROM {table}, fences f WHERE f.variable = '{c}' AND f.q3 - f.q1 <> 0 GROUP BY f.variable, f.lf, f.uf""")
    return f"WITH fences AS ({fences})\n" + "\nUNION ALL\n".join(aggs)


@query("b17_outliers_lineitem", _outliers_sql("lineitem", LINEITEM_NUM))
def b17_outliers_lineitem(spark, sf):
    return X.iqr_outliers(read_table(spark, sf, "lineitem"), LINEITEM_NUM)


# --- B18 / B19 correlations ------------------------------------------------------------

def _pairs_sql(table, cols):
    parts = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            parts.append(f"SELECT {i} AS i, {j} AS j, '{cols[i]}' AS var_a, '{cols[j]}' AS var_b, "
                         f"corr(CAST({q(cols[i])} AS DOUBLE), CAST({q(cols[j])} AS DOUBLE)) AS r FROM {table}")
    return "\nUNION ALL\n".join(parts)


def _corr_matrix_sql(table, cols):
    diag = " UNION ALL ".join(f"SELECT '{c}' AS var_a, '{c}' AS var_b, 1.0 AS r" for c in cols)
    return f"""pairs AS ({_pairs_sql(table, cols)})
SELECT var_a, var_b, round(r, 4) AS r FROM pairs
UNION ALL SELECT var_b AS var_a, var_a AS var_b, round(r, 4) AS r FROM pairs
UNION ALL SELECT var_a, var_b, CAST(r AS DOUBLE) AS r FROM ({diag}) d"""


_OW_NUM = ["o_totalprice", "c_acctbal", "ret_qty"]


@query("b18_corr_matrix_orders_wide", W("orders_wide") + ", " + _corr_matrix_sql("orders_wide", _OW_NUM))
def b18_corr_matrix_orders_wide(spark, sf):
    return X.corr_matrix(D.orders_wide(spark, sf), _OW_NUM)


_LI_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("b18_corr_matrix_lineitem", "WITH " + _corr_matrix_sql("lineitem", _LI_CORR))
def b18_corr_matrix_lineitem(spark, sf):
    return X.corr_matrix(read_table(spark, sf, "lineitem"), _LI_CORR)


@query("b19_top_corr_pairs", f"""WITH pairs AS ({_pairs_sql('lineitem', LINEITEM_NUM)})
SELECT var_a, var_b, round(r, 4) AS r, round(abs(r), 4) AS abs_r, rank FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY abs(r) DESC, var_a, var_b) AS INTEGER) AS rank
  FROM pairs WHERE r IS NOT NULL) t WHERE rank <= 10""")
def b19_top_corr_pairs(spark, sf):
    return X.top_corr_pairs(read_table(spark, sf, "lineitem"), LINEITEM_NUM, 10)


# --- B20 / B21 classes -------------------------------------------------------------

@query("b20_class_distribution", """
SELECT CAST(o_orderstatus AS VARCHAR) AS class, count(*) AS count,
       round(CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (), 2) AS pct
FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus""")
def b20_class_distribution(spark, sf):
    return X.class_distribution(read_table(spark, sf, "orders"), "o_orderstatus")


def _balance_sql(table, target):
    return f"""SELECT n_classes, round(share, 2) AS max_pct,
  CASE WHEN n_classes = 2 THEN (CASE WHEN share > 80 THEN 'strong_imbalance' WHEN share > 60 THEN 'mild_imbalance' ELSE 'balanced' END)
       ELSE (CASE WHEN share > 70 THEN 'strong_imbalance' ELSE 'acceptable' END) END AS grade
FROM (SELECT count(*) AS n_classes, CAST(max(c) AS DOUBLE) * 100 / sum(c) AS share
      FROM (SELECT count(*) AS c FROM {table} WHERE {target} IS NOT NULL GROUP BY {target}) g) s"""


@query("b21_class_balance_orders", _balance_sql("orders", "o_orderstatus"))
def b21_class_balance_orders(spark, sf):
    return X.class_balance(read_table(spark, sf, "orders"), "o_orderstatus")


@query("b21_class_balance_quality", W("doc_labelled") + _balance_sql("doc_labelled", "quality"))
def b21_class_balance_quality(spark, sf):
    return X.class_balance(D.doc_labelled(spark, sf), "quality")


# --- B22 histogram -------------------------------------------------------------------

@query("b22_histogram", """
WITH mm AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
                   (max(l_extendedprice) - min(l_extendedprice)) / 30 AS w FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - mm.lo) / mm.w), 29) AS INTEGER) AS bin
      FROM lineitem, mm WHERE l_extendedprice IS NOT NULL)
SELECT b.bin, round(mm.lo + b.bin * mm.w, 4) AS lo, round(mm.lo + (b.bin + 1) * mm.w, 4) AS hi,
       count(*) AS count
FROM b, mm GROUP BY b.bin, mm.lo, mm.w""")
def b22_histogram(spark, sf):
    return X.histogram(read_table(spark, sf, "lineitem"), "l_extendedprice", 30)


# --- B23 box stats -----------------------------------------------------------------

@query("b23_box_stats", """
WITH f AS (SELECT CAST(l_returnflag AS VARCHAR) AS grp,
             quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median,
             quantile_cont(l_quantity, 0.75) AS q3, avg(l_quantity) AS mean, count(*) AS n
           FROM lineitem WHERE l_quantity IS NOT NULL GROUP BY l_returnflag),
g AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lf, q3 + 1.5 * (q3 - q1) AS uf FROM f)
SELECT g.grp AS "group", g.n, round(g.q1, 4) AS q1, round(g.median, 4) AS median,
  round(g.q3, 4) AS q3, round(g.mean, 4) AS mean,
  round(min(CASE WHEN l.l_quantity >= g.lf AND l.l_quantity <= g.uf THEN l.l_quantity END), 4) AS lower_whisker,
  round(max(CASE WHEN l.l_quantity >= g.lf AND l.l_quantity <= g.uf THEN l.l_quantity END), 4) AS upper_whisker,
  count(CASE WHEN NOT (l.l_quantity >= g.lf AND l.l_quantity <= g.uf) THEN 1 END) AS n_outliers
FROM lineitem l JOIN g ON CAST(l.l_returnflag AS VARCHAR) = g.grp
WHERE l.l_quantity IS NOT NULL
GROUP BY g.grp, g.n, g.q1, g.median, g.q3, g.mean""")
def b23_box_stats(spark, sf):
    return X.box_stats(read_table(spark, sf, "lineitem"), "l_quantity", "l_returnflag")


# --- B24 top categories --------------------------------------------------------------

@query("b24_top_categories", """
SELECT value, count, rank FROM (
  SELECT value, count, CAST(row_number() OVER (ORDER BY count DESC, value) AS INTEGER) AS rank
  FROM (SELECT CAST(p_brand AS VARCHAR) AS value, count(*) AS count FROM part
        WHERE p_brand IS NOT NULL GROUP BY p_brand) g) t WHERE rank <= 20""")
def b24_top_categories(spark, sf):
    return X.top_categories(read_table(spark, sf, "part"), "p_brand", 20)


# --- B25 pair-plot sample --------------------------------------------------------------

@query("b25_pair_sample", f"""
SELECT o_orderkey, o_totalprice, o_orderstatus,
       CAST(dense_rank() OVER (ORDER BY CAST(o_orderstatus AS VARCHAR)) - 1 AS INTEGER) AS color_code
FROM (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
      ORDER BY {seeded_order_sql(42, 'o_orderkey')}, o_orderkey LIMIT 500) s""")
def b25_pair_sample(spark, sf):
    return X.pair_sample(read_table(spark, sf, "orders"), "o_orderkey", ["o_totalprice"],
                         "o_orderstatus", 500, 42)


# --- B14 insights ----------------------------------------------------------------------

def _insights_sql():
    ow = ["o_orderkey", "o_totalprice", "c_acctbal", "ret_qty", "o_orderpriority",
          "c_mktsegment", "ret_status", "o_orderstatus"]
    imb = []
    for t in ["o_orderpriority", "c_mktsegment"]:  # first two candidate targets
        imb.append(f"""SELECT 'imbalance' AS rule, 'warning' AS level, '{t}' AS subject, round(mx, 1) AS value
FROM (SELECT count(*) AS k, CAST(max(c) AS DOUBLE) * 100 / sum(c) AS mx
      FROM (SELECT count(*) AS c FROM orders_wide WHERE {t} IS NOT NULL GROUP BY {t}) g) s
WHERE k >= 2 AND mx > 80""")
    num = ["o_totalprice", "c_acctbal", "ret_qty"]
    return W("orders_wide") + f""", base AS (SELECT count(*) AS n FROM orders_wide),
nz AS (SELECT sum(n_null) AS z FROM ({null_profile_sql('orders_wide', ow)}) p),
pairs AS ({_pairs_sql('orders_wide', num)})
SELECT 'size' AS rule, CASE WHEN n < 100 THEN 'warning' WHEN n > 100000 THEN 'info' ELSE 'ok' END AS level,
  CASE WHEN n < 100 THEN 'small' WHEN n > 100000 THEN 'large' ELSE 'adequate' END AS subject,
  CAST(n AS DOUBLE) AS value FROM base
UNION ALL
SELECT 'nulls', CASE WHEN pct = 0 THEN 'ok' WHEN pct < 30 THEN 'warning' ELSE 'danger' END,
  CASE WHEN pct = 0 THEN 'none' WHEN pct < 5 THEN 'few' WHEN pct < 30 THEN 'moderate' ELSE 'many' END,
  round(pct, 1) FROM (SELECT CAST(z AS DOUBLE) * 100 / (n * {len(ow)}) AS pct FROM nz, base) t
UNION ALL
SELECT 'duplicates', 'warning', 'rows', CAST(d AS DOUBLE) FROM (
  SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM orders_wide) x) AS d FROM orders_wide) t
WHERE d > 0
UNION ALL
{' UNION ALL '.join(imb)}
UNION ALL
SELECT 'high_correlation', 'info', var_a || '|' || var_b, round(abs(r), 4) FROM (
  SELECT *, row_number() OVER (ORDER BY i, j) AS k FROM pairs WHERE abs(r) > 0.9) t WHERE k <= 3"""


@query("b14_insights", _insights_sql())
def b14_insights(spark, sf):
    return X.insights(D.orders_wide(spark, sf))
