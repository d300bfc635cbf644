"""Registered evaluation queries on the rule-scored line items
(F8-F12, G1-G14). The ``scored`` table carries a label, rule predictions and
class scores, so every metric is checkable in SQL before any model exists."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.hashing import seeded_order_sql
from quarry.operators import insights as I
from quarry.operators import metrics as M
from quarry.operators import split as S
from quarry.plans import derived as D
from quarry.plans.catalog import query
from quarry.session import cut_lineage

CLASSES = [0.0, 1.0, 2.0]
SCORES = ["p0", "p1", "p2"]
W = D.with_sql
_ARGMAX = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0.0 WHEN p1 >= p2 THEN 1.0 ELSE 2.0 END"


def _argmax_col():
    return (F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0.0)
             .when(F.col("p1") >= F.col("p2"), 1.0).otherwise(2.0))


def _scored(spark, sf, split=None):
    d = D.scored(spark, sf)
    return d.where(F.col("split") == split) if split else d


def _train_mode(spark, sf):
    tr = _scored(spark, sf, "train")
    return S.fit_baseline(tr, "label")


def _results_by_split(spark, sf, splits=("val",)):
    """(split, model, metrics) for the three models on the given splits.

    The models differ only in their prediction/score columns, so one scan
    of ``scored`` is unpivoted to (model, label, prediction, scores) and
    every metric is computed per (split, model) in the same jobs.
    """
    d = D.scored(spark, sf).where(F.col("split").isin(*splits))
    mode = min(_train_mode(spark, sf), key=lambda c: (-c[1], c[0]))[0]
    third = F.lit(1.0 / 3)
    variants = {
        "discount_rule": (F.col("prediction"), *[F.col(c) for c in SCORES]),
        "argmax_rule": (_argmax_col(), *[F.col(c) for c in SCORES]),
        "most_frequent": (F.lit(float(mode)), third, third, third),
    }
    long = d.select("split", "label", F.inline(F.array(*[
        F.struct(F.lit(name).alias("model"), pred.cast("double").alias("prediction"),
                 *[sc.cast("double").alias(c) for sc, c in zip(scores, SCORES)])
        for name, (pred, *scores) in variants.items()])))
    # one row per (split, model): written once to the shared checkpoint
    # folder, since readings, rankings and the test evaluation read it
    # several times
    return cut_lineage(M.classification_metrics(long, "label", "prediction", SCORES, CLASSES,
                                                groups=["split", "model"]))


def _results(spark, sf, split="val"):
    return _results_by_split(spark, sf, (split,)).select("model", *M.METRICS)


# --- SQL building blocks --------------------------------------------------------------

def _metrics_ctes(p: str, src: str, binary_pos: float | None = None,
                  scores=("s0", "s1", "s2"), classes=CLASSES) -> str:
    """CTEs ending in {p}m(accuracy, precision, recall, f1, auc) for rows
    (label, prediction, s*) of ``src``."""
    if binary_pos is None:
        long = " UNION ALL ".join(
            f"SELECT {c} AS class, label = {c} AS pos, {s} AS s FROM {src} WHERE label IS NOT NULL"
            for c, s in zip(classes, scores))
        avg = f"""round(sum(support * prec) / sum(support), 4) AS precision,
  round(sum(support * rec) / sum(support), 4) AS recall, round(sum(support * f1) / sum(support), 4) AS f1"""
        auc = f"(SELECT coalesce(sum(auc * P) / sum(P), 0.5) FROM {p}pa WHERE auc IS NOT NULL)"
    else:
        long = f"SELECT {binary_pos} AS class, label = {binary_pos} AS pos, {scores[-1]} AS s FROM {src} WHERE label IS NOT NULL"
        pick = lambda c: f"coalesce(max(CASE WHEN class = {binary_pos} THEN {c} END), 0.0)"
        avg = f"round({pick('prec')}, 4) AS precision, round({pick('rec')}, 4) AS recall, round({pick('f1')}, 4) AS f1"
        auc = f"(SELECT coalesce(max(auc), 0.5) FROM {p}pa)"
    return f"""{p}cm AS (SELECT label, prediction, count(*) AS n FROM {src} WHERE label IS NOT NULL GROUP BY label, prediction),
{p}t AS (SELECT label AS class, sum(n) AS support, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp FROM {p}cm GROUP BY label),
{p}pp AS (SELECT prediction AS class, sum(n) AS predicted FROM {p}cm GROUP BY prediction),
{p}pc AS (SELECT coalesce(t.class, q.class) AS class, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
         coalesce(predicted, 0) AS predicted FROM {p}t t FULL JOIN {p}pp q ON t.class = q.class),
{p}pr AS (SELECT *, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS prec,
              CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS rec FROM {p}pc),
{p}f AS (SELECT *, CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM {p}pr),
{p}long AS ({long}),
{p}sc AS (SELECT class, s, count(CASE WHEN pos THEN 1 END) AS pos, count(CASE WHEN NOT pos THEN 1 END) AS neg
          FROM {p}long GROUP BY class, s),
{p}cu AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY class ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM {p}sc),
{p}pa AS (SELECT class, sum(pos) AS P, sum(neg) AS N,
          CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg * 0.5)) / (sum(pos) * sum(neg)) END AS auc
          FROM {p}cu GROUP BY class),
{p}m AS (SELECT round(CAST(sum(tp) AS DOUBLE) / sum(support), 4) AS accuracy, {avg}, round({auc}, 4) AS auc FROM {p}f)"""


_MODEL_SRC = {
    "discount_rule": "SELECT label, prediction, p0 AS s0, p1 AS s1, p2 AS s2 FROM {t}",
    "argmax_rule": f"SELECT label, {_ARGMAX} AS prediction, p0 AS s0, p1 AS s1, p2 AS s2 FROM {{t}}",
    "most_frequent": ("SELECT label, (SELECT label FROM (SELECT label, count(*) AS n FROM scored WHERE split = 'train' "
                      "GROUP BY label ORDER BY n DESC, label LIMIT 1) z) AS prediction, 1.0/3 AS s0, 1.0/3 AS s1, 1.0/3 AS s2 FROM {t}"),
}


def _results_ctes(split="val"):
    parts = [f"vrows AS (SELECT * FROM scored WHERE split = '{split}')"]
    for i, (name, src) in enumerate(_MODEL_SRC.items()):
        parts.append(f"src{i} AS ({src.format(t='vrows')})")
        parts.append(_metrics_ctes(f"m{i}_", f"src{i}"))
    union = " UNION ALL ".join(f"SELECT '{n}' AS model, * FROM m{i}_m" for i, n in enumerate(_MODEL_SRC))
    parts.append(f"results AS ({union})")
    return ",\n".join(parts)


def _wsql(body: str) -> str:
    return W("scored") + ", " + body


# --- F8 / F9 / F10 / F11 / F12 ----------------------------------------------------------

@query("f8_metrics_multiclass", _wsql(
    "v AS (SELECT label, prediction, p0 AS s0, p1 AS s1, p2 AS s2 FROM scored WHERE split = 'val'),\n"
    + _metrics_ctes("a_", "v") + "\nSELECT * FROM a_m"))
def f8_metrics_multiclass(spark, sf):
    return M.classification_metrics(_scored(spark, sf, "val"), "label", "prediction", SCORES, CLASSES)


@query("f8_metrics_binary", _wsql(
    "v AS (SELECT bin_label AS label, bin_pred AS prediction, bin_score AS s0 FROM scored WHERE split = 'val'),\n"
    + _metrics_ctes("b_", "v", binary_pos=1.0, scores=("s0",), classes=[1.0]) + "\nSELECT * FROM b_m"))
def f8_metrics_binary(spark, sf):
    return M.classification_metrics(_scored(spark, sf, "val"), "bin_label", "bin_pred",
                                    ["bin_score"], [0.0, 1.0])


@query("f9_overfit_gap", _wsql(f"""
tr AS (SELECT label, prediction, p0 AS s0, p1 AS s1, p2 AS s2 FROM scored WHERE split = 'train'),
va AS (SELECT label, prediction, p0 AS s0, p1 AS s1, p2 AS s2 FROM scored WHERE split = 'val'),
{_metrics_ctes('t_', 'tr')},
{_metrics_ctes('v_', 'va')}
SELECT t_m.accuracy AS train_accuracy, v_m.accuracy AS val_accuracy,
       round(t_m.accuracy - v_m.accuracy, 4) AS overfit_gap, (t_m.accuracy - v_m.accuracy) > 0.15 AS overfit_warning
FROM t_m, v_m"""))
def f9_overfit_gap(spark, sf):
    tr = M.classification_metrics(_scored(spark, sf, "train"), "label", "prediction",
                                  None, CLASSES).select(F.col("accuracy").alias("train_accuracy"))
    va = M.classification_metrics(_scored(spark, sf, "val"), "label", "prediction",
                                  None, CLASSES).select(F.col("accuracy").alias("val_accuracy"))
    j = tr.withColumn("_k", F.lit(1)).join(va.withColumn("_k", F.lit(1)), "_k").drop("_k")
    gap = F.col("train_accuracy") - F.col("val_accuracy")
    return j.select("train_accuracy", "val_accuracy", F.round(gap, 4).alias("overfit_gap"),
                    (gap > 0.15).alias("overfit_warning"))


@query("f10_result_table", _wsql(_results_ctes() + "\nSELECT * FROM results"))
def f10_result_table(spark, sf):
    return _results(spark, sf)


def _fold_sql():
    o = seeded_order_sql(42, "key")
    return f"""fr AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY {o}, key) - 1) * 5
               // count(*) OVER (PARTITION BY label) AS fold
             FROM scored WHERE split = 'train' AND label IS NOT NULL)"""


def _fold_f1_sql(pred: str) -> str:
    return f"""(SELECT fold, sum(support * f1) / sum(support) AS f1 FROM (
  SELECT fold, class, support,
    CASE WHEN prec + rec > 0 THEN 2 * prec * rec / (prec + rec) ELSE 0.0 END AS f1 FROM (
    SELECT fold, class, support, CASE WHEN predicted > 0 THEN CAST(tp AS DOUBLE) / predicted ELSE 0.0 END AS prec,
           CASE WHEN support > 0 THEN CAST(tp AS DOUBLE) / support ELSE 0.0 END AS rec FROM (
      SELECT coalesce(t.fold, q.fold) AS fold, coalesce(t.class, q.class) AS class, coalesce(support, 0) AS support,
             coalesce(tp, 0) AS tp, coalesce(predicted, 0) AS predicted
      FROM (SELECT fold, label AS class, count(*) AS support, count(CASE WHEN label = {pred} THEN 1 END) AS tp
            FROM fr GROUP BY fold, label) t
      FULL JOIN (SELECT fold, {pred} AS class, count(*) AS predicted FROM fr GROUP BY fold, {pred}) q
      ON t.fold = q.fold AND t.class = q.class) a) b) c GROUP BY fold)"""


@query("f11_cv_comparison", _wsql(_results_ctes() + f""",
{_fold_sql()}
SELECT 'discount_rule' AS model, round(avg(f1), 4) AS cv_mean, round(stddev_pop(f1), 4) AS cv_std FROM {_fold_f1_sql('prediction')} x
UNION ALL
SELECT 'argmax_rule', round(avg(f1), 4), round(stddev_pop(f1), 4) FROM {_fold_f1_sql(_ARGMAX)} y
UNION ALL
SELECT model, f1, 0.0 FROM results WHERE model = 'most_frequent'"""))
def f11_cv_comparison(spark, sf):
    """Two rules with five folds, the majority baseline with its single F1."""
    folds = S.stratified_folds(_scored(spark, sf, "train"), "key", "label", 5, 42)
    long = folds.select("fold", "label", F.inline(F.array(
        F.struct(F.lit("discount_rule").alias("model"), F.col("prediction").cast("double").alias("prediction")),
        F.struct(F.lit("argmax_rule").alias("model"), _argmax_col().alias("prediction")))))
    per_fold = M.classification_metrics(long, "label", "prediction", None, CLASSES, ["model", "fold"], digits=None)
    return M.cv_comparison(_results(spark, sf), per_fold)


@query("f12_training_facts", _wsql("""t AS (SELECT * FROM scored WHERE split = 'train')
SELECT count(*) AS n_rows, 3 AS n_features, count(DISTINCT label) AS n_classes,
       CASE WHEN count(DISTINCT label) = 2 THEN 'binary' ELSE 'weighted' END AS averaging FROM t"""))
def f12_training_facts(spark, sf):
    t = _scored(spark, sf, "train")
    return t.agg(F.count(F.lit(1)).alias("n_rows"), F.lit(len(SCORES)).alias("n_features"),
                 F.count_distinct("label").alias("n_classes")).withColumn(
        "averaging", F.when(F.col("n_classes") == 2, "binary").otherwise("weighted"))


# --- G1-G3 ---------------------------------------------------------------------------

@query("g1_confusion_matrix", _wsql("""v AS (SELECT * FROM scored WHERE split = 'val'),
cm AS (SELECT label, prediction, count(*) AS n FROM v GROUP BY label, prediction),
cl AS (SELECT label AS c FROM cm UNION SELECT prediction FROM cm)
SELECT a.c AS label, b.c AS prediction, coalesce(cm.n, 0) AS count,
       round(CAST(coalesce(cm.n, 0) AS DOUBLE) * 100 / sum(coalesce(cm.n, 0)) OVER (), 2) AS pct
FROM cl a CROSS JOIN cl b LEFT JOIN cm ON cm.label = a.c AND cm.prediction = b.c"""))
def g1_confusion_matrix(spark, sf):
    return M.confusion_matrix(_scored(spark, sf, "val"))


@query("g2_classification_report", _wsql("""v AS (SELECT label, prediction, p0 AS s0, p1 AS s1, p2 AS s2 FROM scored WHERE split = 'val'),
""" + _metrics_ctes("r_", "v") + """
SELECT CAST(class AS VARCHAR) AS "row", round(prec, 4) AS precision, round(rec, 4) AS recall, round(f1, 4) AS f1,
       CAST(support AS BIGINT) AS support FROM r_f
UNION ALL SELECT 'accuracy', NULL, NULL, round(CAST(sum(tp) AS DOUBLE) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM r_f
UNION ALL SELECT 'macro avg', round(avg(prec), 4), round(avg(rec), 4), round(avg(f1), 4), CAST(sum(support) AS BIGINT) FROM r_f
UNION ALL SELECT 'weighted avg', round(sum(support * prec) / sum(support), 4), round(sum(support * rec) / sum(support), 4),
                 round(sum(support * f1) / sum(support), 4), CAST(sum(support) AS BIGINT) FROM r_f"""))
def g2_classification_report(spark, sf):
    return M.classification_report(_scored(spark, sf, "val"))


@query("g3_top_errors", _wsql("""v AS (SELECT * FROM scored WHERE split = 'val')
SELECT label, prediction, count, rank FROM (
  SELECT label, prediction, n AS count, CAST(row_number() OVER (ORDER BY n DESC, label, prediction) AS INTEGER) AS rank
  FROM (SELECT label, prediction, count(*) AS n FROM v WHERE label <> prediction GROUP BY label, prediction) c) t
WHERE rank <= 10"""))
def g3_top_errors(spark, sf):
    return M.top_errors(_scored(spark, sf, "val"))


# --- G4-G6 ROC ------------------------------------------------------------------------

def _roc_points_sql(src: str) -> str:
    """CTE text `pts(class, threshold, fpr, tpr)` from rows (class, pos, s) in src."""
    return f"""sc AS (SELECT class, s, count(CASE WHEN pos THEN 1 END) AS pos, count(CASE WHEN NOT pos THEN 1 END) AS neg
          FROM {src} GROUP BY class, s),
tot AS (SELECT class, sum(pos) AS P, sum(neg) AS N FROM sc GROUP BY class),
every AS (SELECT sc.class, s AS threshold, pos, neg,
            lag(s) OVER (PARTITION BY sc.class ORDER BY s DESC) AS above,
            lead(pos) OVER (PARTITION BY sc.class ORDER BY s DESC) AS next_pos,
            lead(neg) OVER (PARTITION BY sc.class ORDER BY s DESC) AS next_neg,
            CAST(sum(neg) OVER (PARTITION BY sc.class ORDER BY s DESC) AS DOUBLE) / tot.N AS fpr,
            CAST(sum(pos) OVER (PARTITION BY sc.class ORDER BY s DESC) AS DOUBLE) / tot.P AS tpr
          FROM sc JOIN tot ON sc.class = tot.class),
pts AS (SELECT class, threshold, fpr, tpr FROM every
        WHERE above IS NULL OR next_pos IS NULL OR next_pos <> pos OR next_neg <> neg
        UNION ALL SELECT class, CAST(NULL AS DOUBLE), 0.0, 0.0 FROM tot)"""


@query("g4_binary_roc", _wsql("""lg AS (SELECT 1.0 AS class, bin_label = 1.0 AS pos, bin_score AS s
                             FROM scored WHERE split = 'val' AND bin_label IS NOT NULL),
""" + _roc_points_sql("lg") + """
SELECT threshold, round(fpr, 4) AS fpr, round(tpr, 4) AS tpr FROM pts"""))
def g4_binary_roc(spark, sf):
    return M.binary_roc(_scored(spark, sf, "val"), "bin_label", "bin_score", 1.0)


_LONG3 = """lg AS (SELECT 0.0 AS class, label = 0.0 AS pos, p0 AS s FROM scored WHERE split = 'val'
        UNION ALL SELECT 1.0, label = 1.0, p1 FROM scored WHERE split = 'val'
        UNION ALL SELECT 2.0, label = 2.0, p2 FROM scored WHERE split = 'val')"""

_MACRO = _LONG3 + ",\n" + _roc_points_sql("lg") + """,
grid AS (SELECT DISTINCT fpr FROM pts),
u AS (SELECT class, fpr, tpr, 0 AS kind FROM pts
      UNION ALL SELECT c.class, g.fpr, CAST(NULL AS DOUBLE), 1 FROM grid g, (VALUES (0.0), (1.0), (2.0)) c(class)),
w AS (SELECT class, fpr, kind,
        last_value(tpr IGNORE NULLS) OVER (PARTITION BY class ORDER BY fpr, kind, tpr NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t_lo,
        last_value(CASE WHEN kind = 0 THEN fpr END IGNORE NULLS) OVER (PARTITION BY class ORDER BY fpr, kind, tpr NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f_lo,
        first_value(tpr IGNORE NULLS) OVER (PARTITION BY class ORDER BY fpr, kind, tpr NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t_hi,
        first_value(CASE WHEN kind = 0 THEN fpr END IGNORE NULLS) OVER (PARTITION BY class ORDER BY fpr, kind, tpr NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS f_hi
      FROM u),
g AS (SELECT fpr, sum(CASE WHEN f_hi IS NULL OR f_lo = fpr THEN t_lo
                           ELSE t_lo + (fpr - f_lo) * (t_hi - t_lo) / (f_hi - f_lo) END) / 3 AS tpr
      FROM w WHERE kind = 1 GROUP BY fpr)"""


@query("g5_macro_roc_curve", _wsql(_MACRO + "\nSELECT round(fpr, 4) AS fpr, round(tpr, 4) AS tpr FROM g"))
def g5_macro_roc_curve(spark, sf):
    return M.macro_roc(_scored(spark, sf, "val"), "label", SCORES, CLASSES)[0]


@query("g5_macro_auc", _wsql(_MACRO + """
SELECT round(sum((fpr - pf) * (tpr + pt) / 2), 4) AS macro_auc FROM (
  SELECT fpr, tpr, lag(fpr) OVER (ORDER BY fpr) AS pf, lag(tpr) OVER (ORDER BY fpr) AS pt FROM g) t"""))
def g5_macro_auc(spark, sf):
    return M.macro_roc(_scored(spark, sf, "val"), "label", SCORES, CLASSES)[1]


@query("g6_per_class_auc", _wsql("""v AS (SELECT label, prediction, p0 AS s0, p1 AS s1, p2 AS s2 FROM scored WHERE split = 'val'),
""" + _metrics_ctes("c_", "v") + "\nSELECT class, P, N, round(auc, 4) AS auc FROM c_pa"))
def g6_per_class_auc(spark, sf):
    long = M.per_class_roc(_scored(spark, sf, "val"), "label", SCORES, CLASSES)
    return M._ovr_auc(long).select("class", "P", "N", F.round("auc", 4).alias("auc"))


# --- G7-G10 --------------------------------------------------------------------------

@query("g7_auc_ranking", _wsql(_results_ctes() + """
SELECT model, auc, CASE WHEN auc > 0.9 THEN 'excellent' WHEN auc > 0.8 THEN 'very_good' WHEN auc > 0.7 THEN 'good'
  WHEN auc > 0.6 THEN 'moderate' ELSE 'poor' END AS grade,
  CAST(row_number() OVER (ORDER BY auc DESC, model) AS INTEGER) AS rank FROM results"""))
def g7_auc_ranking(spark, sf):
    return M.auc_ranking(_results(spark, sf))


@query("g8_model_ranking", _wsql(_results_ctes() + """
SELECT *, CASE rank WHEN 1 THEN 'gold' WHEN 2 THEN 'silver' WHEN 3 THEN 'bronze' END AS medal FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY f1 DESC, model) AS INTEGER) AS rank FROM results) r"""))
def g8_model_ranking(spark, sf):
    return M.model_ranking(_results(spark, sf))


@query("g9_metric_long", _wsql(_results_ctes() + """
SELECT model, bar_order, metric, value FROM (
  SELECT *, CAST(row_number() OVER (ORDER BY f1 DESC, model) AS INTEGER) AS bar_order FROM results) r,
  (VALUES ('accuracy'), ('precision'), ('recall'), ('f1'), ('auc')) m(metric),
  LATERAL (SELECT CASE m.metric WHEN 'accuracy' THEN r.accuracy WHEN 'precision' THEN r.precision
      WHEN 'recall' THEN r.recall WHEN 'f1' THEN r.f1 ELSE r.auc END AS value) v
WHERE bar_order <= 4"""))
def g9_metric_long(spark, sf):
    return M.metric_long(_results(spark, sf))


def _test_eval_sql():
    val = _results_ctes("val")
    test = _results_ctes("test").replace("vrows", "trows").replace("src", "tsrc").replace(
        "m0_", "n0_").replace("m1_", "n1_").replace("m2_", "n2_").replace("results AS", "tresults AS")
    return _wsql(val + ",\n" + test + """,
best AS (SELECT model FROM results ORDER BY f1 DESC, model LIMIT 1)
SELECT b.model, m.metric, m.val, m.test, round(m.test - m.val, 4) AS delta FROM best b,
LATERAL (SELECT 'accuracy' AS metric, r.accuracy AS val, t.accuracy AS test FROM results r, tresults t WHERE r.model = b.model AND t.model = b.model
  UNION ALL SELECT 'precision', r.precision, t.precision FROM results r, tresults t WHERE r.model = b.model AND t.model = b.model
  UNION ALL SELECT 'recall', r.recall, t.recall FROM results r, tresults t WHERE r.model = b.model AND t.model = b.model
  UNION ALL SELECT 'f1', r.f1, t.f1 FROM results r, tresults t WHERE r.model = b.model AND t.model = b.model
  UNION ALL SELECT 'auc', r.auc, t.auc FROM results r, tresults t WHERE r.model = b.model AND t.model = b.model) m""")


@query("g10_test_evaluation", _test_eval_sql())
def g10_test_evaluation(spark, sf):
    # val and test in the same jobs; the best validation model (F1 desc,
    # then name) is picked by a window over the (model x split) table
    res = _results_by_split(spark, sf, ("val", "test"))
    val = res.where(F.col("split") == "val").drop("split")
    first = val.select("model", F.row_number().over(
        Window.orderBy(F.desc("f1"), "model")).alias("_r")).where("_r = 1").select("model")
    v = val.join(first, "model")
    test = res.where(F.col("split") == "test").drop("split").join(first, "model")
    lv = v.select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("val"))
                                               for m in M.METRICS])).alias("x")).select("model", "x.*")
    lt = test.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("test"))
                                         for m in M.METRICS])).alias("x")).select("x.*")
    return lv.join(lt, "metric").select("model", "metric", "val", "test",
                                        F.round(F.col("test") - F.col("val"), 4).alias("delta"))


# --- G11-G14 readings -----------------------------------------------------------------

@query("g11_confusion_reading", _wsql("""v AS (SELECT * FROM scored WHERE split = 'val'),
c AS (SELECT count(CASE WHEN bin_label = 1.0 AND bin_pred = 1.0 THEN 1 END) AS tp,
             count(CASE WHEN bin_label <> 1.0 AND bin_pred <> 1.0 THEN 1 END) AS tn,
             count(CASE WHEN bin_label <> 1.0 AND bin_pred = 1.0 THEN 1 END) AS fp,
             count(CASE WHEN bin_label = 1.0 AND bin_pred <> 1.0 THEN 1 END) AS fn FROM v)
SELECT tp, tn, fp, fn, round(CAST(fp AS DOUBLE) * 100 / (tp + tn + fp + fn), 1) AS fp_pct,
       round(CAST(fn AS DOUBLE) * 100 / (tp + tn + fp + fn), 1) AS fn_pct,
       fn > tp * 0.3 AS high_fn, fp > tn * 0.3 AS high_fp FROM c"""))
def g11_confusion_reading(spark, sf):
    return I.confusion_reading(_scored(spark, sf, "val"), "bin_label", "bin_pred", 1.0)


@query("g11_confusion_reading_multiclass", _wsql("""v AS (SELECT * FROM scored WHERE split = 'val'),
cm AS (SELECT label, prediction, count(*) AS n FROM v GROUP BY label, prediction),
t AS (SELECT label AS class, sum(n) AS total_real, sum(CASE WHEN label = prediction THEN n ELSE 0 END) AS tp FROM cm GROUP BY label),
p AS (SELECT prediction AS class, sum(n) AS total_pred FROM cm GROUP BY prediction)
SELECT t.class, tp, total_real, coalesce(total_pred, 0) AS total_pred,
       round(CAST(tp AS DOUBLE) / greatest(total_real, 1), 4) AS recall,
       round(CAST(tp AS DOUBLE) / greatest(coalesce(total_pred, 0), 1), 4) AS precision
FROM t LEFT JOIN p ON t.class = p.class"""))
def g11_confusion_reading_multiclass(spark, sf):
    return I.confusion_reading_multiclass(M.confusion_counts(_scored(spark, sf, "val")))


@query("g12_metric_reading", _wsql(_results_ctes() + """,
r AS (SELECT *, (SELECT f1 FROM results WHERE model = 'most_frequent') AS baseline_f1 FROM results)
SELECT model, f1,
  CASE WHEN f1 >= 0.9 THEN 'excellent' WHEN f1 >= 0.8 THEN 'very_good' WHEN f1 >= 0.7 THEN 'good'
       WHEN f1 >= 0.6 THEN 'moderate' ELSE 'improvable' END AS f1_tier,
  round((f1 - baseline_f1) / greatest(baseline_f1, 0.001) * 100, 1) AS gain_pct,
  CASE WHEN (f1 - baseline_f1) / greatest(baseline_f1, 0.001) * 100 > 20 THEN 'clearly_better'
       WHEN (f1 - baseline_f1) / greatest(baseline_f1, 0.001) * 100 > 5 THEN 'slightly_better'
       WHEN (f1 - baseline_f1) / greatest(baseline_f1, 0.001) * 100 > 0 THEN 'marginally_better'
       ELSE 'not_better' END AS gain_tier,
  CASE WHEN precision > 0 AND recall > 0 THEN
    CASE WHEN precision > recall + 0.15 THEN 'precise' WHEN recall > precision + 0.15 THEN 'sensitive' ELSE 'balanced' END END AS pr_lean,
  CASE WHEN auc > 0.9 THEN 'excellent' WHEN auc > 0.8 THEN 'good' WHEN auc > 0.7 THEN 'moderate' ELSE 'poor' END AS auc_tier
FROM r"""))
def g12_metric_reading(spark, sf):
    res = _results(spark, sf)
    b = res.where(F.col("model") == "most_frequent").select(F.col("f1").alias("baseline_f1"))
    j = res.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return I.metric_reading(j)


@query("g13_comparison_reading", _wsql(_results_ctes() + """,
b AS (SELECT model, f1 FROM results ORDER BY f1 DESC, model LIMIT 1),
w AS (SELECT model, f1 FROM results ORDER BY f1, model LIMIT 1)
SELECT b.model AS best_model, b.f1 AS best_f1, w.model AS worst_model, w.f1 AS worst_f1,
       round(b.f1 - w.f1, 4) AS f1_gap, (b.f1 - w.f1) > 0.1 AS clear_winner, b.f1 < 0.9 AS tune_advice
FROM b, w"""))
def g13_comparison_reading(spark, sf):
    return I.comparison_reading(_results(spark, sf))


@query("g14_recommendations", _wsql(_results_ctes() + """,
facts AS (SELECT (SELECT count(*) FROM scored) AS n_rows, 0 AS null_cells, 0 AS n_categorical,
  b.f1, b.precision, b.recall, CAST(NULL AS DOUBLE) AS silhouette
  FROM (SELECT * FROM results ORDER BY f1 DESC, model LIMIT 1) b),
rules AS (
  SELECT 0 AS pos, 'small_dataset' AS rule, coalesce(n_rows < 500, FALSE) AS fired FROM facts
  UNION ALL SELECT 1, 'nulls_present', coalesce(null_cells > 0, FALSE) FROM facts
  UNION ALL SELECT 2, 'many_categoricals', coalesce(n_categorical > 10, FALSE) FROM facts
  UNION ALL SELECT 3, 'low_f1', coalesce(f1 < 0.6, FALSE) FROM facts
  UNION ALL SELECT 4, 'precision_recall_gap', coalesce(abs(precision - recall) > 0.2, FALSE) FROM facts
  UNION ALL SELECT 5, 'low_silhouette', coalesce(silhouette < 0.3, FALSE) FROM facts)
SELECT pos, rule FROM rules WHERE fired
UNION ALL SELECT 6, 'no_issues' FROM (SELECT max(CAST(fired AS INTEGER)) AS a FROM rules) t WHERE a = 0"""))
def g14_recommendations(spark, sf):
    from quarry.operators.profile import null_profile
    d = D.scored(spark, sf)
    best = _results(spark, sf).orderBy(F.desc("f1"), "model").limit(1)
    nulls = null_profile(d).agg(F.sum("n_null").alias("null_cells"))
    n = d.agg(F.count(F.lit(1)).alias("n_rows"))
    facts = (best.withColumn("_k", F.lit(1)).join(nulls.withColumn("_k", F.lit(1)), "_k")
             .join(n.withColumn("_k", F.lit(1)), "_k")
             .select("n_rows", "null_cells", F.lit(0).alias("n_categorical"), "f1", "precision",
                     "recall", F.lit(None).cast("double").alias("silhouette")))
    return I.recommendations(facts)
