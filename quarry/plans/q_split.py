"""Registered split, fold and baseline queries (D1-D10, F6 folds)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.hashing import seeded_order_sql, seeded_uniform, seeded_uniform_sql
from quarry.operators import metrics as M
from quarry.operators import split as S
from quarry.plans.catalog import query
from quarry.session import cut_lineage
from quarry.sources.tables import read_table

PLAN = S.SplitPlan(70, 50)
_TPM, _VPM, _XPM = PLAN.train_pm, PLAN.val_pm, PLAN.test_pm
_D = _TPM + _VPM
_ORD = seeded_order_sql(42, "o_orderkey")


def _orders_split(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return S.stratified_split(o, "o_orderkey", "o_orderstatus", PLAN, 42)


_STRAT_SQL = f"""strat AS (
  SELECT o_orderkey, o_orderstatus,
    CASE WHEN r < nt THEN 'test' WHEN r < nt + ((n - nt) * {_VPM} + {_D - 1}) // {_D} THEN 'val' ELSE 'train' END AS split
  FROM (SELECT *, (n * {_XPM} + 999) // 1000 AS nt FROM (
    SELECT o_orderkey, o_orderstatus,
      row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_ORD}, o_orderkey) - 1 AS r,
      count(*) OVER (PARTITION BY o_orderstatus) AS n
    FROM orders WHERE o_orderstatus IS NOT NULL) a) b)"""


@query("d1_stratified_split", f"WITH {_STRAT_SQL} SELECT o_orderkey, o_orderstatus, split FROM strat")
def d1_stratified_split(spark, sf):
    return _orders_split(spark, sf)


@query("d2_hash_split", f"""
SELECT o_orderkey, CASE WHEN r < nt THEN 'test' WHEN r < nt + ((n - nt) * {_VPM} + {_D - 1}) // {_D} THEN 'val'
  ELSE 'train' END AS split
FROM (SELECT *, (n * {_XPM} + 999) // 1000 AS nt FROM (
  SELECT o_orderkey, row_number() OVER (ORDER BY {_ORD}) - 1 AS r, count(*) OVER () AS n FROM orders) a) b""")
def d2_hash_split(spark, sf):
    return S.shuffled_split(read_table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", PLAN, 42)


@query("d3_ordered_split", f"""
SELECT o_orderkey, CASE WHEN r < n - nt - nv THEN 'train' WHEN r < n - nt THEN 'val' ELSE 'test' END AS split
FROM (SELECT *, ((n - nt) * {_VPM} + {_D - 1}) // {_D} AS nv FROM (
  SELECT *, (n * {_XPM} + 999) // 1000 AS nt FROM (
    SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS r, count(*) OVER () AS n
    FROM orders) a) b) c""")
def d3_ordered_split(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey")
    return S.ordered_split(o, "o_orderkey", PLAN)


@query("d4_split_sizes", f"""WITH {_STRAT_SQL}
SELECT split, CASE split WHEN 'train' THEN {_TPM / 10} WHEN 'val' THEN {_VPM / 10} ELSE {_XPM / 10} END AS planned_pct,
  CAST(floor(sum(n) OVER () * CASE split WHEN 'train' THEN {_TPM} WHEN 'val' THEN {_VPM} ELSE {_XPM} END / 1000) AS BIGINT) AS planned_n,
  n, round(CAST(n AS DOUBLE) * 100 / sum(n) OVER (), 2) AS pct
FROM (SELECT split, count(*) AS n FROM strat GROUP BY split) g""")
def d4_split_sizes(spark, sf):
    return S.split_sizes(_orders_split(spark, sf), PLAN)


@query("d5_class_share_by_split", f"""WITH {_STRAT_SQL}
SELECT split, o_orderstatus AS class, n, round(CAST(n AS DOUBLE) * 100 / sum(n) OVER (PARTITION BY split), 2) AS pct
FROM (SELECT split, o_orderstatus, count(*) AS n FROM strat GROUP BY split, o_orderstatus) g""")
def d5_class_share_by_split(spark, sf):
    return S.class_share_by_split(_orders_split(spark, sf), "o_orderstatus")


@query("d6_stratification_check", f"""WITH {_STRAT_SQL},
g AS (SELECT o_orderstatus, count(CASE WHEN split = 'train' THEN 1 END) AS tr,
             count(CASE WHEN split = 'val' THEN 1 END) AS va FROM strat
      WHERE split IN ('train', 'val') GROUP BY o_orderstatus)
SELECT round(max(abs(CAST(tr AS DOUBLE) / st - CAST(va AS DOUBLE) / sv)), 4) AS max_diff,
       round(max(abs(CAST(tr AS DOUBLE) / st - CAST(va AS DOUBLE) / sv)), 4) < 0.05 AS stratified_ok
FROM g, (SELECT sum(tr) AS st, sum(va) AS sv FROM g) t""")
def d6_stratification_check(spark, sf):
    return S.stratification_check(_orders_split(spark, sf), "o_orderstatus")


@query("f6_stratified_folds", f"""
SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_ORD}, o_orderkey) - 1) * 5
  // count(*) OVER (PARTITION BY o_orderstatus) AS INTEGER) AS fold
FROM orders WHERE o_orderstatus IS NOT NULL""")
def f6_stratified_folds(spark, sf):
    o = read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return S.stratified_folds(o, "o_orderkey", "o_orderstatus", 5, 42).select("o_orderkey", "fold")


# --- baselines D7-D10 -----------------------------------------------------------------

def _labelled_split(spark, sf):
    """Stratified split with the target encoded to its sorted class code.

    The baselines read the split three times (class list, fit on train,
    score val), so it is written once to the shared checkpoint folder."""
    d = cut_lineage(_orders_split(spark, sf))
    classes = [r[0] for r in d.select("o_orderstatus").distinct().orderBy("o_orderstatus").collect()]
    code = F.lit(None).cast("double")
    for i, c in enumerate(classes):
        code = F.when(F.col("o_orderstatus") == c, float(i)).otherwise(code)
    return d.withColumn("label", code)


def _baseline(spark, sf, strategy):
    d = _labelled_split(spark, sf)
    classes = S.fit_baseline(d.where(F.col("split") == "train"), "label")
    return S.baseline_predict(d.where(F.col("split") == "val"), "o_orderkey", classes, strategy, 42)


_LAB_SQL = f"""{_STRAT_SQL},
lab AS (SELECT *, CAST(dense_rank() OVER (ORDER BY o_orderstatus) - 1 AS DOUBLE) AS label FROM strat),
cls AS (SELECT label, count(*) AS n FROM lab WHERE split = 'train' GROUP BY label),
cum AS (SELECT label, CAST(sum(n) OVER (ORDER BY label) AS DOUBLE) / sum(n) OVER () AS c FROM cls),
cls_r AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx FROM cls),
val AS (SELECT *, {seeded_uniform_sql(42, 'o_orderkey')} AS u FROM lab WHERE split = 'val')"""

_PRED_SQL = {
    "stratified": "(SELECT min(label) FROM cum WHERE val.u < cum.c)",
    "most_frequent": "(SELECT label FROM cls ORDER BY n DESC, label LIMIT 1)",
    "uniform": "(SELECT label FROM cls_r WHERE idx = CAST(least(floor(val.u * (SELECT count(*) FROM cls)), (SELECT count(*) FROM cls) - 1) AS BIGINT))",
}


def _baseline_sql(strategy):
    return f"""WITH {_LAB_SQL}
SELECT o_orderkey, CAST(coalesce({_PRED_SQL[strategy]}, (SELECT max(label) FROM cls)) AS DOUBLE) AS prediction FROM val"""


@query("d7_baseline_stratified", _baseline_sql("stratified"))
def d7_baseline_stratified(spark, sf):
    return _baseline(spark, sf, "stratified").select("o_orderkey", "prediction")


@query("d8_baseline_most_frequent", _baseline_sql("most_frequent"))
def d8_baseline_most_frequent(spark, sf):
    return _baseline(spark, sf, "most_frequent").select("o_orderkey", "prediction")


@query("d9_baseline_uniform", _baseline_sql("uniform"))
def d9_baseline_uniform(spark, sf):
    return _baseline(spark, sf, "uniform").select("o_orderkey", "prediction")


def _weighted_metrics_sql(src: str) -> str:
    """Support-weighted accuracy/precision/recall/f1 of (label, prediction) rows in ``src``."""
    return f"""(WITH cm AS (SELECT label, prediction, count(*) AS n FROM {src} GROUP BY label, prediction),
t AS (SELECT label AS class, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp FROM cm GROUP BY label),
p AS (SELECT prediction AS class, sum(n) AS predicted FROM cm GROUP BY prediction),
pc AS (SELECT coalesce(t.class, p.class) AS class, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
         coalesce(predicted, 0) AS predicted FROM t FULL JOIN p ON t.class = p.class),
pr AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS prec,
              CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS rec FROM pc),
f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM pr)
SELECT round(CAST(sum(tp) AS DOUBLE) / sum(support), 4) AS accuracy,
       round(sum(support * prec) / sum(support), 4) AS precision,
       round(sum(support * rec) / sum(support), 4) AS recall,
       round(sum(support * f1) / sum(support), 4) AS f1 FROM f)"""


@query("d10_baseline_metrics", f"""WITH {_LAB_SQL},
preds AS (
  SELECT 'stratified' AS strategy, label, CAST(coalesce({_PRED_SQL['stratified']}, (SELECT max(label) FROM cls)) AS DOUBLE) AS prediction FROM val
  UNION ALL SELECT 'most_frequent', label, CAST({_PRED_SQL['most_frequent']} AS DOUBLE) FROM val
  UNION ALL SELECT 'uniform', label, CAST({_PRED_SQL['uniform']} AS DOUBLE) FROM val)
SELECT s.strategy, m.accuracy, m.precision, m.recall, m.f1, 0.5 AS auc,
       round(1.0 / (SELECT count(*) FROM cls), 4) AS random_line, round(least(1.0, m.f1 + 0.15), 4) AS goal_line
FROM (SELECT DISTINCT strategy FROM preds) s,
LATERAL {_weighted_metrics_sql("(SELECT * FROM preds WHERE preds.strategy = s.strategy)")} m""")
def d10_baseline_metrics(spark, sf):
    d = _labelled_split(spark, sf)
    classes = S.fit_baseline(d.where(F.col("split") == "train"), "label")
    val = d.where(F.col("split") == "val")
    # the three strategies as one unpivoted scan, evaluated per strategy
    u = seeded_uniform(42, F.col("o_orderkey"))
    long = val.select("label", F.inline(F.array(*[
        F.struct(F.lit(st).alias("strategy"), S.baseline_expr(u, classes, st).alias("prediction"))
        for st in ("stratified", "most_frequent", "uniform")])))
    out = M.classification_metrics(long, "label", "prediction",
                                   classes=[c for c, _ in classes], groups=["strategy"])
    return out.select("*", F.round(F.lit(1.0 / len(classes)), 4).alias("random_line"),
                      F.round(F.least(F.lit(1.0), F.col("f1") + 0.15), 4).alias("goal_line"))
