"""Evaluation metrics on any (label, prediction[, scores]) table
(SURVEY F8-F12, G1-G10).

All count-based metrics come from ONE ``groupBy(label, prediction).count()``
(partially aggregated, k^2 rows out); AUCs come from per-(class, score)
positive/negative counts and exact running sums (``running_sums``), never
from a global window over rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.ranking import running_sums
from quarry.functions.stats import rnd
from quarry.session import cut_lineage

METRICS = ("accuracy", "precision", "recall", "f1", "auc")


def confusion_counts(df: DataFrame, label: str = "label",
                     prediction: str = "prediction", groups: Sequence[str] = ()) -> DataFrame:
    return (df.where(F.col(label).isNotNull())
            .groupBy(*groups, F.col(label).cast("double").alias("label"),
                     F.col(prediction).cast("double").alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def per_class(cm: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Per class: tp, support (true count), predicted count, precision,
    recall, f1 (0 when a denominator is 0). Input: confusion counts."""
    t = cm.groupBy(*groups, F.col("label").alias("class")).agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    p = cm.groupBy(*groups, F.col("prediction").alias("class")).agg(F.sum("n").alias("predicted"))
    j = t.join(p, [*groups, "class"], "full").fillna(0, ["support", "tp", "predicted"])
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    j = j.withColumns({"precision": prec, "recall": rec})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(0.0)
    return j.withColumn("f1", f1)


def binary_auc(df: DataFrame, label: str, score: str, positive: float = 1.0,
               groups: Sequence[str] = ()) -> DataFrame:
    """Exact binary AUC with averaged ties: one row (auc) per group."""
    return _ovr_auc(df.select(*groups, F.lit(positive).alias("class"),
                              (F.col(label).cast("double") == positive).alias("pos"),
                              F.col(score).cast("double").alias("s")), groups).select(*groups, "auc")


def _score_counts(long: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """(class, s) -> pos/neg counts from rows (class, pos, s)."""
    return long.groupBy(*groups, "class", "s").agg(
        F.count(F.when(F.col("pos"), 1)).alias("pos"),
        F.count(F.when(~F.col("pos"), 1)).alias("neg"))


def _ovr_auc(long: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Per class AUC from rows (class, pos bool, s score)."""
    sc = _score_counts(long, groups)
    cum = running_sums(sc, [*groups, "class"], "s", ["neg"], inclusive_ties=False)  # one row a score
    # neg strictly below s = before_neg; ties count one half
    term = F.col("pos") * (F.col("before_neg") + F.col("neg") * 0.5)
    return cum.groupBy(*groups, "class").agg(
        F.sum(term).alias("_num"), F.sum("pos").alias("P"), F.sum("neg").alias("N")
    ).select(*groups, "class", "P", "N", F.when((F.col("P") > 0) & (F.col("N") > 0),
                                       F.col("_num") / (F.col("P") * F.col("N"))).alias("auc"))


def multiclass_auc(df: DataFrame, label: str, score_cols: Sequence[str],
                   classes: Sequence[float], groups: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest AUC per class (score column i belongs to classes[i])."""
    long = df.where(F.col(label).isNotNull()).select(*groups, F.explode(F.array(*[
        F.struct(F.lit(float(c)).alias("class"),
                 (F.col(label).cast("double") == float(c)).alias("pos"),
                 F.col(s).cast("double").alias("s"))
        for c, s in zip(classes, score_cols)])).alias("x")).select(*groups, "x.*")
    return _ovr_auc(long, groups)


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                           score_cols: Sequence[str] | None = None,
                           classes: Sequence[float] | None = None,
                           groups: Sequence[str] = (), digits: int | None = 4) -> DataFrame:
    """F8: one row – accuracy, precision, recall, f1, auc (``digits`` dp) – per group.

    Two classes: values of the positive (last sorted) class and binary AUC
    on ``score_cols[-1]``. More: support-weighted averages and the
    support-weighted one-vs-rest AUC over the classes present. AUC falls
    back to 0.5 when no score is given or it is undefined.

    ``groups`` evaluates many (model, split) slices of one long table in the
    same jobs: every count and running sum is keyed by the group columns
    too, so N models cost one scan instead of N.
    """
    groups = list(groups)
    cm = confusion_counts(df, label, prediction, groups)
    if classes is None:
        classes = [r["label"] for r in cm.select("label").distinct().orderBy("label")
                   .collect()]  # one number per class
    classes = [float(c) for c in classes]
    pc = per_class(cm, groups)
    n = F.sum("support")
    acc = F.try_divide(F.sum("tp"), n)
    if len(classes) == 2:
        pos = classes[-1]
        pick = lambda c: F.max(F.when(F.col("class") == pos, F.col(c)))
        agg = pc.groupBy(*groups).agg(acc.alias("accuracy"), F.coalesce(pick("precision"), F.lit(0.0)).alias("precision"),
                     F.coalesce(pick("recall"), F.lit(0.0)).alias("recall"),
                     F.coalesce(pick("f1"), F.lit(0.0)).alias("f1"))
    else:
        wavg = lambda c: F.try_divide(F.sum(F.col("support") * F.col(c)), n)
        agg = pc.groupBy(*groups).agg(acc.alias("accuracy"), wavg("precision").alias("precision"),
                     wavg("recall").alias("recall"), wavg("f1").alias("f1"))
    if score_cols:
        if len(classes) == 2:
            a = binary_auc(df, label, score_cols[-1], classes[-1], groups)
            auc = a.select(*groups, F.coalesce(F.col("auc"), F.lit(0.5)).alias("auc"))
        else:
            a = multiclass_auc(df, label, score_cols, classes, groups)
            auc = a.where(F.col("auc").isNotNull()).groupBy(*groups).agg(
                F.coalesce(F.try_divide(F.sum(F.col("auc") * F.col("P")), F.sum("P")), F.lit(0.5)).alias("auc"))
        if groups:
            # one row per group on both sides (bounded by the group count)
            agg = agg.join(auc, groups, "left").withColumn(
                "auc", F.coalesce(F.col("auc"), F.lit(0.5)))
        else:
            # both sides are single rows: a one-row x one-row join on a constant key
            agg = agg.withColumn("_k", F.lit(1)).join(auc.withColumn("_k", F.lit(1)), "_k").drop("_k")
    else:
        agg = agg.withColumn("auc", F.lit(0.5))
    return agg.select(*groups, *[(F.col(m) if digits is None else rnd(F.col(m), digits)).alias(m) for m in METRICS])


def metrics_long(df: DataFrame, model: str, **kw) -> DataFrame:
    """F10 input: (model, metric, value) rows for one model."""
    m = classification_metrics(df, **kw)
    return m.select(F.lit(model).alias("model"), F.explode(F.array(*[
        F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in METRICS]))
        .alias("x")).select("model", "x.metric", "x.value")


def result_table(long: DataFrame) -> DataFrame:
    """pivot (model, metric, value) to one row per model."""
    return long.groupBy("model").pivot("metric", list(METRICS)).agg(F.first("value"))


def cv_comparison(results: DataFrame, folds: DataFrame, metric: str = "f1") -> DataFrame:
    """(model, cv_mean, cv_std) of every model of ``results`` (F10): mean and
    population deviation over its rows in ``folds`` (model, fold, metric); a model
    without folds has its single result and deviation 0."""
    cv = folds.groupBy("model").agg(rnd(F.avg(metric)).alias("cv_mean"), rnd(F.stddev_pop(metric)).alias("cv_std"))
    return results.select("model", metric).join(cv, "model", "left").select(
        "model", F.coalesce("cv_mean", rnd(F.col(metric))).alias("cv_mean"), F.coalesce("cv_std", F.lit(0.0)).alias("cv_std"))


# --- G1-G3 ------------------------------------------------------------------

def confusion_matrix(df: DataFrame, label: str = "label", prediction: str = "prediction",
                     classes: Sequence[float] | None = None) -> DataFrame:
    """G1: all k x k cells (zeros included) with count and % of all rows. The cells
    that occur are ``confusion_counts``; this view fills up the rest."""
    cm = confusion_counts(df, label, prediction)
    cells = F.array(F.col("label"), F.col("prediction"))
    known = F.array(*map(F.lit, map(float, classes))) if classes else None
    # one row: the class list and the number of rows
    every = cm.select(F.explode(cells).alias("c"), F.lit(0).alias("_one")).groupBy("_one").agg(
        (known if known is not None else F.array_sort(F.collect_set("c"))).alias("classes"))
    total = cm.groupBy(F.lit(0).alias("_one")).agg(F.sum("n").alias("total"))
    grid = every.join(total, "_one").select("total", "classes", F.explode("classes").alias("label")).select(
        "total", "label", F.explode("classes").alias("prediction"))
    g = grid.join(cm, ["label", "prediction"], "left").fillna(0, ["n"])
    return g.select("label", "prediction", F.col("n").alias("count"),
                    F.round(F.col("n") * 100.0 / F.col("total"), 2).alias("pct"))


def classification_report(df: DataFrame, label: str = "label",
                          prediction: str = "prediction") -> DataFrame:
    """Per class precision/recall/f1/support + accuracy, macro and
    weighted averages (4 dp); ``row`` names the line."""
    pc = per_class(confusion_counts(df, label, prediction))
    per = pc.select(F.col("class").cast("string").alias("row"), rnd(F.col("precision")).alias("precision"),
                    rnd(F.col("recall")).alias("recall"), rnd(F.col("f1")).alias("f1"),
                    F.col("support").cast("bigint").alias("support"))
    n = F.sum("support")
    acc = pc.agg(F.lit("accuracy").alias("row"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), rnd(F.try_divide(F.sum("tp"), n)).alias("f1"),
                 n.cast("bigint").alias("support"))
    macro = pc.agg(F.lit("macro avg").alias("row"), rnd(F.avg("precision")).alias("precision"),
                   rnd(F.avg("recall")).alias("recall"), rnd(F.avg("f1")).alias("f1"),
                   n.cast("bigint").alias("support"))
    w = lambda c: rnd(F.try_divide(F.sum(F.col("support") * F.col(c)), n))
    weighted = pc.agg(F.lit("weighted avg").alias("row"), w("precision").alias("precision"),
                      w("recall").alias("recall"), w("f1").alias("f1"),
                      n.cast("bigint").alias("support"))
    return per.unionByName(acc).unionByName(macro).unionByName(weighted)


def top_errors(df: DataFrame, label: str = "label", prediction: str = "prediction",
               k: int = 10) -> DataFrame:
    """Most frequent off-diagonal cells (count desc, then label, prediction)."""
    cm = confusion_counts(df, label, prediction).where(F.col("label") != F.col("prediction"))
    w = Window.orderBy(F.desc("n"), "label", "prediction")  # at most k^2 rows
    return (cm.select("label", "prediction", F.col("n").alias("count"),
                      F.row_number().over(w).alias("rank")).where(F.col("rank") <= k))


# --- G4-G6 ROC ------------------------------------------------------------------

def roc_points(long: DataFrame) -> DataFrame:
    """Per class ROC points (threshold desc): (class, threshold, fpr, tpr), the
    start (0, 0) with threshold NULL, and the scores at which the curve turns: an
    inner point is left out if the next score adds as many positives and as many
    negatives as its own did. Input rows (class, pos, s)."""
    sc = _score_counts(long)
    cum = running_sums(sc, ["class"], "s", ["pos", "neg"], descending=True, inclusive_ties=False,
                       next_cols=["pos", "neg"])
    # a class that is absent, or alone, has no curve
    tot = sc.groupBy("class").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N")).where("P > 0 and N > 0")
    turns = "next_pos is null or before_pos + before_neg = 0 or next_pos != pos or next_neg != neg"
    pts = cum.where(turns).join(tot, "class").select(
        "class", F.col("s").alias("threshold"),
        F.try_divide(F.col("cum_neg"), F.col("N")).alias("fpr"), F.try_divide(F.col("cum_pos"), F.col("P")).alias("tpr"))
    start = tot.select("class", F.lit(None).cast("double").alias("threshold"),
                       F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def binary_roc(df: DataFrame, label: str, score: str, positive: float = 1.0) -> DataFrame:
    """ROC curve of a binary score (4 dp)."""
    long = df.where(F.col(label).isNotNull()).select(
        F.lit(positive).alias("class"), (F.col(label).cast("double") == positive).alias("pos"),
        F.col(score).cast("double").alias("s"))
    return roc_points(long).select("threshold", rnd(F.col("fpr")).alias("fpr"),
                                   rnd(F.col("tpr")).alias("tpr"))


def per_class_roc(df: DataFrame, label: str, score_cols: Sequence[str],
                  classes: Sequence[float]) -> DataFrame:
    """One-vs-rest ROC points and AUC per class."""
    long = df.where(F.col(label).isNotNull()).select(F.explode(F.array(*[
        F.struct(F.lit(float(c)).alias("class"),
                 (F.col(label).cast("double") == float(c)).alias("pos"),
                 F.col(s).cast("double").alias("s"))
        for c, s in zip(classes, score_cols)])).alias("x")).select("x.*")
    return long


#: Slopes are summed as decimals, so that what is taken off again leaves nothing behind.
SLOPE = "decimal(38,12)"


def macro_roc(df: DataFrame, label: str, score_cols: Sequence[str],
              classes: Sequence[float], n_buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Macro-average ROC – union grid of all classes' FPRs, each class's
    TPR linearly interpolated at every grid point (the last point at an
    equal FPR wins), averaged; AUC by the trapezoid rule over the grid.

    Returns (curve(fpr, tpr), auc one row). Scale: a class's curve is straight
    between its own points, so the sum over classes changes its slope and jumps
    only there. Each point hands on what it changes; the changes are added up by
    FPR, and two running sums over the grid give the slope after each grid point
    and from it the sum of curves. Nothing is as large as classes x grid.
    ``n_buckets`` is the number of ranges (shuffle partitions if None).
    """
    return macro_curve(per_class_roc(df, label, score_cols, classes), n_buckets)


def macro_curve(long: DataFrame, n_buckets: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``macro_roc`` of rows (class, pos, s), for any number of classes."""
    pts = roc_points(long)
    cp = pts.groupBy("class", "fpr").agg(F.min("tpr").alias("t_first"), F.max("tpr").alias("t_last"),
                                         F.lit(0).alias("zero"))
    cp = running_sums(cp, ["class"], "fpr", ["zero"], n_buckets=n_buckets, inclusive_ties=False, next_cols=["fpr", "t_first"])
    slope = ((F.col("next_t_first") - F.col("t_last")) / (F.col("next_fpr") - F.col("fpr"))).cast(SLOPE)
    none = F.lit(0).cast(SLOPE)
    changes = cp.select(F.inline(F.array(
        F.struct("fpr", F.coalesce(slope, none).alias("slope"), (F.col("t_last") - F.col("t_first")).alias("jump"),
                 F.when(F.col("fpr") == 0, F.col("t_first")).otherwise(0.0).alias("begin"),
                 F.when(F.col("fpr") == 0, 1).otherwise(0).alias("curves")),
        F.struct(F.coalesce("next_fpr", "fpr").alias("fpr"), F.coalesce(-slope, none).alias("slope"), F.lit(0.0).alias("jump"),
                 F.lit(0.0).alias("begin"), F.lit(0).alias("curves")))))
    grid = changes.groupBy("fpr").agg(F.sum("slope").cast(SLOPE).alias("slope"), F.sum(F.col("jump") + F.col("begin")).alias("jump"),
                                      F.sum("curves").alias("curves"))
    grid = running_sums(grid, [], "fpr", ["slope", "curves"], n_buckets=n_buckets, inclusive_ties=False, next_cols=["fpr"])
    grid = grid.select("fpr", "jump", "next_fpr", F.col("cum_curves").alias("k"),
                       (F.col("cum_slope").cast("double") * (F.col("next_fpr") - F.col("fpr"))).alias("rise")).fillna(0.0, ["rise"])
    grid = running_sums(grid, [], "fpr", ["jump", "rise"], n_buckets=n_buckets, inclusive_ties=False)
    g = cut_lineage(grid.select("fpr", "next_fpr", ((F.col("cum_jump") + F.col("before_rise")) / F.col("k")).alias("tpr"),
                                (F.col("rise") / F.col("k")).alias("rise"), "jump", "k"))
    # the trapezoid from a grid point to the next one ends at that one's own (last) value
    g2 = running_sums(g.withColumn("zero", F.lit(0)), [], "fpr", ["zero"], n_buckets=n_buckets, inclusive_ties=False, next_cols=["tpr"])
    auc = g2.agg(F.sum((F.col("next_fpr") - F.col("fpr")) * (F.col("tpr") + F.col("next_tpr")) / 2).alias("auc"))
    return (g.select(rnd(F.col("fpr")).alias("fpr"), rnd(F.col("tpr")).alias("tpr")),
            auc.select(rnd(F.col("auc")).alias("macro_auc")))


# --- G7-G9 --------------------------------------------------------------------

def auc_grade(c: Column) -> Column:
    return (F.when(c > 0.9, "excellent").when(c > 0.8, "very_good").when(c > 0.7, "good")
             .when(c > 0.6, "moderate").otherwise("poor"))


def auc_ranking(results: DataFrame) -> DataFrame:
    """Models by AUC desc with the quality grade."""
    w = Window.orderBy(F.desc("auc"), "model")  # one row per model
    return results.select("model", "auc", auc_grade(F.col("auc")).alias("grade"),
                          F.row_number().over(w).alias("rank"))


def model_ranking(results: DataFrame) -> DataFrame:
    """Models by F1 desc (then name), rank 1..n, medal for the first 3."""
    w = Window.orderBy(F.desc("f1"), "model")
    r = results.select("*", F.row_number().over(w).alias("rank"))
    return r.withColumn("medal", F.when(F.col("rank") == 1, "gold").when(F.col("rank") == 2, "silver")
                        .when(F.col("rank") == 3, "bronze"))


def metric_long(results: DataFrame, models: int = 4, order_by: str = "f1") -> DataFrame:
    """Metric x model long table for at most 4 models (best by
    ``order_by`` first), with the bar order."""
    w = Window.orderBy(F.desc(order_by), "model")
    top = results.select("*", F.row_number().over(w).alias("bar_order")).where(
        F.col("bar_order") <= models)
    return top.select("model", "bar_order", F.explode(F.array(*[
        F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS]))
        .alias("x")).select("model", "bar_order", "x.metric", "x.value")
