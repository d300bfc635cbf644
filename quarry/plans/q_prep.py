"""Registered preparation queries (C1-C18). Parameters are fitted on the
training rows of a hash split of ``orders_wide`` and applied to all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.hashing import seeded_order_sql
from quarry.operators import prep as C
from quarry.operators import profile as P
from quarry.operators import split as S
from quarry.plans import derived as D
from quarry.plans.catalog import query
from quarry.plans.q_profile import DOC_LABELLED_COLS, EVENTS_STR_COLS
from quarry.plans.sqlgen import profile_sql

NUM = ["o_totalprice", "c_acctbal", "ret_qty"]
CAT = ["o_orderpriority", "c_mktsegment", "ret_status"]
_C1, _C2 = S.hash_split_cuts(S.SplitPlan(70, 50))
_H = f"substr({seeded_order_sql(42, 'o_orderkey')}, 1, 4)"
_OW = D.with_sql("orders_wide") + f""", ow AS (SELECT *, CASE WHEN {_H} < '{_C1}' THEN 'train'
  WHEN {_H} < '{_C2}' THEN 'val' ELSE 'test' END AS split FROM orders_wide),
tr AS (SELECT * FROM ow WHERE split = 'train')"""


def _ow(spark, sf):
    return S.hash_split(D.orders_wide(spark, sf), "o_orderkey", S.SplitPlan(70, 50), 42)


def _fit(spark, sf, **kw):
    d = _ow(spark, sf)
    spec = C.PrepSpec(target="o_orderstatus", exclude=("o_orderkey", "split"), **kw)
    return d, C.fit_prep(d, spec, train_filter=F.col("split") == "train")


# --- C1-C3 ---------------------------------------------------------------------------

@query("c1_default_exclusions", D.with_sql("doc_labelled") + f""", p AS ({profile_sql('doc_labelled', DOC_LABELLED_COLS)})
SELECT column_name, role FROM (SELECT *, row_number() OVER (ORDER BY position) AS k FROM p
  WHERE role IN ('id_like', 'text', 'datetime')) t WHERE k <= 5""")
def c1_default_exclusions(spark, sf):
    p = P.column_roles(D.doc_labelled(spark, sf))
    ex = C.default_exclusions(P.collect_profile(D.doc_labelled(spark, sf)))
    return p.where(F.col("column_name").isin(ex)).select("column_name", "role")


@query("c2_dropped_columns", D.with_sql("doc_labelled") + f"""
SELECT column_name, null_pct FROM (
  {' UNION ALL '.join(f"SELECT '{c}' AS column_name, round(CAST(count(*) - count({c}) AS DOUBLE) * 100 / count(*), 2) AS null_pct FROM doc_labelled WHERE substr({seeded_order_sql(42, 'doc_id')}, 1, 4) < '{_C1}'" for c, _ in DOC_LABELLED_COLS)}
) t WHERE null_pct > 50""")
def c2_dropped_columns(spark, sf):
    d = S.hash_split(D.doc_labelled(spark, sf), "doc_id", S.SplitPlan(70, 50), 42)
    tr = d.where(F.col("split") == "train").drop("split")
    return P.null_profile(tr).where(F.col("null_pct") > C.NULL_DROP_PCT).select("column_name", "null_pct")


_EV_STR = [c for c, t in EVENTS_STR_COLS if t == "string"]


@query("c3_recast_numeric_categoricals", D.with_sql("events_str") + f""", p AS ({profile_sql('events_str', EVENTS_STR_COLS)})
SELECT column_name FROM p WHERE role = 'categorical' AND dtype = 'string' AND all_numeric""")
def c3_recast_numeric_categoricals(spark, sf):
    d = D.events_str(spark, sf)
    prof = P.collect_profile(d)
    cats = [c for c in prof.cols("categorical") if prof.dtypes[c] == "string"]
    _, rec = C.recast_numeric_categoricals(d.select(*cats), cats)
    return P.column_roles(d).where(F.col("column_name").isin(rec)).select("column_name")


# --- C4 / C5 imputation ------------------------------------------------------------------

@query("c4_numeric_impute", _OW + """,
st AS (SELECT quantile_cont(ret_qty, 0.5) AS med, avg(ret_qty) AS mean FROM tr),
md AS (SELECT ret_qty AS mode FROM tr WHERE ret_qty IS NOT NULL GROUP BY ret_qty ORDER BY count(*) DESC, ret_qty LIMIT 1)
SELECT o_orderkey, round(coalesce(ret_qty, med), 4) AS median_fill, round(coalesce(ret_qty, mean), 4) AS mean_fill,
       round(coalesce(ret_qty, mode), 4) AS mode_fill, round(coalesce(ret_qty, 0.0), 4) AS const_fill
FROM ow, st, md""")
def c4_numeric_impute(spark, sf):
    d = _ow(spark, sf)
    out = d.select("o_orderkey")
    cols = {}
    for strat, name in (("median", "median_fill"), ("mean", "mean_fill"),
                        ("most_frequent", "mode_fill"), ("constant", "const_fill")):
        m = C.fit_prep(d.select("o_orderkey", "ret_qty", "split"),
                       C.PrepSpec(exclude=("o_orderkey", "split"), num_impute=strat, scaler="none"),
                       train_filter=F.col("split") == "train")
        cols[name] = F.round(m.num_expr("ret_qty"), 4)
    return d.select("o_orderkey", *[v.alias(k) for k, v in cols.items()])


@query("c5_categorical_impute", _OW + """,
md AS (SELECT ret_status AS mode FROM tr WHERE ret_status IS NOT NULL GROUP BY ret_status ORDER BY count(*) DESC, ret_status LIMIT 1)
SELECT o_orderkey, coalesce(ret_status, mode) AS mode_fill, coalesce(ret_status, 'missing') AS const_fill FROM ow, md""")
def c5_categorical_impute(spark, sf):
    d = _ow(spark, sf)
    fills = {}
    for strat, name in (("most_frequent", "mode_fill"), ("constant", "const_fill")):
        m = C.fit_prep(d.select("o_orderkey", "ret_status", "split"),
                       C.PrepSpec(exclude=("o_orderkey", "split"), cat_impute=strat),
                       train_filter=F.col("split") == "train")
        fills[name] = m.cat_value("ret_status")
    return d.select("o_orderkey", *[v.alias(k) for k, v in fills.items()])


# --- C6-C9 scaling --------------------------------------------------------------------------

def _imp_sql():
    return """,
med AS (SELECT quantile_cont(o_totalprice, 0.5) AS m0, quantile_cont(c_acctbal, 0.5) AS m1, quantile_cont(ret_qty, 0.5) AS m2 FROM tr),
imp AS (SELECT o_orderkey, split, coalesce(o_totalprice, m0) AS o_totalprice, coalesce(c_acctbal, m1) AS c_acctbal,
               coalesce(ret_qty, m2) AS ret_qty FROM ow, med),
itr AS (SELECT * FROM imp WHERE split = 'train')"""


def _scaled_sql(center, scale):
    cols = ", ".join(f"round((i.{c} - s.c_{c}) / s.s_{c}, 4) + 0.0 AS {c}" for c in NUM)
    st = ", ".join(f"{center.format(c=c)} AS c_{c}, {scale.format(c=c)} AS s_{c}" for c in NUM)
    return _OW + _imp_sql() + f""",
s AS (SELECT {st} FROM itr)
SELECT i.o_orderkey, {cols} FROM imp i, s"""


def _scaled(spark, sf, scaler):
    d, m = _fit(spark, sf, scaler=scaler)
    return d.select("o_orderkey", *[F.round(m.num_expr(c), 4).alias(c) for c in NUM])


@query("c6_standard_scale", _scaled_sql("avg({c})", "CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END"))
def c6_standard_scale(spark, sf):
    return _scaled(spark, sf, "standard")


@query("c7_minmax_scale", _scaled_sql("min({c})", "CASE WHEN max({c}) <> min({c}) THEN max({c}) - min({c}) ELSE 1.0 END"))
def c7_minmax_scale(spark, sf):
    return _scaled(spark, sf, "minmax")


@query("c8_robust_scale", _scaled_sql(
    "quantile_cont({c}, 0.5)",
    "CASE WHEN quantile_cont({c}, 0.75) <> quantile_cont({c}, 0.25) THEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) ELSE 1.0 END"))
def c8_robust_scale(spark, sf):
    return _scaled(spark, sf, "robust")


@query("c9_no_scaling", _OW + _imp_sql() + """
SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, round(c_acctbal, 4) AS c_acctbal, round(ret_qty, 4) AS ret_qty FROM imp""")
def c9_no_scaling(spark, sf):
    return _scaled(spark, sf, "none")


# --- C10-C12 encoding ------------------------------------------------------------------------

def _cat_imp_sql():
    modes = ",\n".join(
        f"md_{c} AS (SELECT {c} AS v FROM tr WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"
        for c in CAT)
    sel = ", ".join(f"coalesce(ow.{c}, md_{c}.v) AS {c}" for c in CAT)
    frm = ", ".join(f"md_{c}" for c in CAT)
    return f""",
{modes},
cimp AS (SELECT ow.o_orderkey, ow.split, {sel} FROM ow, {frm}),
ctr AS (SELECT * FROM cimp WHERE split = 'train')"""


# Category lists are data; the oracle derives its own from the training rows
# and must agree with ours. We express the one-hot twin with a pivot over the
# sorted distinct training values.
def _onehot_pivot_sql():
    parts = []
    for c in CAT:
        parts.append(f"""SELECT i.o_orderkey, '{c}_' || k.v AS feature, CAST(i.{c} = k.v AS DOUBLE) AS value
FROM cimp i, (SELECT DISTINCT {c} AS v FROM ctr) k""")
    return _OW + _cat_imp_sql() + "\n" + "\nUNION ALL\n".join(parts)


@query("c10_onehot_long", _onehot_pivot_sql())
def c10_onehot_long(spark, sf):
    """One-hot features in long form (row key, feature, 0/1 value)."""
    d, m = _fit(spark, sf, encoder="onehot")
    exprs = []
    for c in m.categorical:
        exprs += m.cat_exprs(c)
    wide = d.select("o_orderkey", *exprs)
    names = [n for n in m.feature_names if n not in m.numeric]
    return wide.select("o_orderkey", F.explode(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("value")) for n in names]))
        .alias("x")).select("o_orderkey", "x.feature", "x.value")


def _label_sql():
    codes = ", ".join(
        f"coalesce((SELECT CAST(r - 1 AS DOUBLE) FROM (SELECT v, row_number() OVER (ORDER BY v) AS r FROM "
        f"(SELECT DISTINCT {c} AS v FROM ctr) x) y WHERE y.v = i.{c}), -1.0) AS {c}" for c in CAT)
    return _OW + _cat_imp_sql() + f"\nSELECT i.o_orderkey, {codes} FROM cimp i"


@query("c11_label_encoding", _label_sql())
def c11_label_encoding(spark, sf):
    d, m = _fit(spark, sf, encoder="label")
    return m.transform(d, keep=["o_orderkey"], with_label=False).select("o_orderkey", *m.categorical)


@query("c12_ordinal_encoding", _label_sql())
def c12_ordinal_encoding(spark, sf):
    d, m = _fit(spark, sf, encoder="ordinal")
    return m.transform(d, keep=["o_orderkey"], with_label=False).select("o_orderkey", *m.categorical)


# --- C13/C15/C16/C17/C18 -----------------------------------------------------------------------

@query("c13_column_transformer_shape", _OW + f"""
SELECT count(*) AS n_rows,
  {len(NUM)} + (SELECT count(DISTINCT o_orderpriority) FROM tr) + (SELECT count(DISTINCT c_mktsegment) FROM tr)
   + (SELECT count(DISTINCT coalesce(ret_status, (SELECT ret_status FROM tr WHERE ret_status IS NOT NULL GROUP BY ret_status ORDER BY count(*) DESC, ret_status LIMIT 1))) FROM tr) AS n_features,
  count(DISTINCT o_orderstatus) AS n_classes
FROM ow WHERE o_orderstatus IS NOT NULL""")
def c13_column_transformer_shape(spark, sf):
    d, m = _fit(spark, sf)
    t = m.transform(d, keep=["o_orderkey"])
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(m.feature_names)).alias("n_features"),
                 F.count_distinct("label").alias("n_classes"))


def _vector_values_sql():
    scaled = "\nUNION ALL\n".join(
        f"SELECT i.o_orderkey, {k} AS place, round((i.{c} - s.c_{c}) / s.s_{c}, 4) + 0.0 AS value FROM imp i, s"
        for k, c in enumerate(NUM))
    st = ", ".join(f"avg({c}) AS c_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS s_{c}" for c in NUM)
    dictionary = "\nUNION ALL\n".join(f"SELECT DISTINCT {k} AS col, {c} AS v FROM ctr" for k, c in enumerate(CAT))
    hot = "\nUNION ALL\n".join(
        f"SELECT c.o_orderkey, p.place, 1.0 AS value FROM cimp c JOIN places p ON p.col = {k} AND p.v = c.{c}" for k, c in enumerate(CAT))
    return _OW + _imp_sql() + _cat_imp_sql() + f""",
s AS (SELECT {st} FROM itr),
dic AS ({dictionary}),
places AS (SELECT col, v, {len(NUM)} - 1 + row_number() OVER (ORDER BY col, v) AS place FROM dic),
vals AS ({scaled}
UNION ALL
{hot})
SELECT v.o_orderkey, CAST(v.place AS INTEGER) AS place, CAST(v.value AS DOUBLE) AS value
FROM vals v JOIN ow ON ow.o_orderkey = v.o_orderkey WHERE ow.o_orderstatus IS NOT NULL AND v.value <> 0"""


@query("c13_column_transformer_values", _vector_values_sql())
def c13_column_transformer_values(spark, sf):
    """Every value of the assembled vectors that is not 0: (row, place, value)."""
    from pyspark.ml.functions import vector_to_array
    d, m = _fit(spark, sf)
    v = m.vectors(d, keep=["o_orderkey"])
    return v.select("o_orderkey", F.posexplode(vector_to_array("features")).alias("place", "value")) \
        .select("o_orderkey", "place", F.round("value", 4).alias("value")).where("value != 0")


@query("c15_feature_names", _OW + _cat_imp_sql() + """
SELECT CAST(row_number() OVER (ORDER BY grp, name) - 1 AS INTEGER) AS position, name FROM (
  SELECT 0 AS grp, 'c_acctbal' AS name WHERE FALSE
  UNION ALL SELECT 0, '0:o_totalprice' UNION ALL SELECT 0, '1:c_acctbal' UNION ALL SELECT 0, '2:ret_qty'
  UNION ALL SELECT DISTINCT 1, 'o_orderpriority_' || o_orderpriority FROM ctr
  UNION ALL SELECT DISTINCT 2, 'c_mktsegment_' || c_mktsegment FROM ctr
  UNION ALL SELECT DISTINCT 3, 'ret_status_' || ret_status FROM ctr) t""")
def c15_feature_names(spark, sf):
    d, m = _fit(spark, sf)
    names = [f"{i}:{n}" if n in m.numeric else n for i, n in enumerate(m.feature_names)]
    return d.sparkSession.createDataFrame(list(enumerate(names)), "position int, name string")


@query("c16_target_encoding", """
SELECT o_orderstatus AS class, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT o_orderstatus FROM orders WHERE o_orderstatus IS NOT NULL) t""")
def c16_target_encoding(spark, sf):
    from quarry.sources.tables import read_table
    return C.target_dictionary(read_table(spark, sf, "orders"), "o_orderstatus")


@query("c17_pipeline_transform", _OW + _imp_sql() + _cat_imp_sql() + """,
s AS (SELECT avg(o_totalprice) AS m0, stddev_pop(o_totalprice) AS s0, avg(c_acctbal) AS m1, stddev_pop(c_acctbal) AS s1,
             avg(ret_qty) AS m2, stddev_pop(ret_qty) AS s2 FROM itr)
SELECT i.o_orderkey, round((i.o_totalprice - m0) / s0, 4) + 0.0 AS o_totalprice, round((i.c_acctbal - m1) / s1, 4) + 0.0 AS c_acctbal,
       round((i.ret_qty - m2) / s2, 4) + 0.0 AS ret_qty, c.o_orderpriority, c.c_mktsegment, c.ret_status,
       CAST(dense_rank() OVER (ORDER BY o.o_orderstatus) - 1 AS DOUBLE) AS label
FROM imp i JOIN cimp c ON i.o_orderkey = c.o_orderkey JOIN ow o ON o.o_orderkey = i.o_orderkey, s
WHERE o.o_orderstatus IS NOT NULL""")
def c17_pipeline_transform(spark, sf):
    """Fit on train rows, transform every row: numeric features, the imputed
    categorical values (found again by their codes) and the encoded label."""
    d, m = _fit(spark, sf, encoder="label")
    t = m.transform(d, keep=["o_orderkey"])
    for c in m.categorical:
        t = t.join(m.dictionary(c).select(F.col("code").cast("double").alias(c), F.col("value").alias(f"{c}_value")), c, "left")
    return t.select("o_orderkey", *(F.round(c, 4).alias(c) for c in m.numeric),
                    *(F.col(f"{c}_value").alias(c) for c in m.categorical), "label")


@query("c18_before_after", _OW + _imp_sql() + """
SELECT 'before' AS stage, count(*) AS n_rows, 8 AS n_cols, 3 AS n_numeric, 4 AS n_categorical,
  CAST(sum(CASE WHEN ret_qty IS NULL THEN 1 ELSE 0 END) + sum(CASE WHEN ret_status IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null_cells
FROM orders_wide
UNION ALL
SELECT 'after', count(*), 5, 4, 0, CAST(0 AS BIGINT) FROM ow WHERE o_orderstatus IS NOT NULL""")
def c18_before_after(spark, sf):
    d, m = _fit(spark, sf, encoder="label")
    after = m.transform(d, keep=["o_orderkey"]).drop(*[c for c in m.categorical])
    return C.before_after(D.orders_wide(spark, sf), after)


@query("c14_pca")
def c14_pca(spark, sf):
    """PCA to 2 components of the standardised numeric features (rows-only)."""
    d, m = _fit(spark, sf)
    t = m.transform(d, keep=["o_orderkey"])
    out, ratios = C.pca_fit_transform(t, m.numeric, 2, keep=["o_orderkey"])
    return out
