"""Rule tables that turn results into readings.

Each rule is a CASE expression over a small result table (metrics, profile,
confusion counts); the natural-language wording of the reference is left to
the caller – we return the rule ids, levels and figures.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.stats import rnd

# Fixed thresholds that must equal the reference's rules.
SEG_GOOD, SEG_OK = 0.5, 0.3
TRAIT_PCT = 20.0
TRAIT_MAX_VARS, TRAIT_MAX_SHOWN = 8, 4
F1_TIERS = [(0.90, "excellent"), (0.80, "very_good"), (0.70, "good"), (0.60, "moderate")]
GAIN_TIERS = [(20, "clearly_better"), (5, "slightly_better"), (0, "marginally_better")]
PR_LEAN = 0.15
AUC_TIERS = [(0.9, "excellent"), (0.8, "good"), (0.7, "moderate")]


def segmentation_grade(sil: Column) -> Column:
    """> 0.5 good, > 0.3 acceptable, else poor."""
    return F.when(sil > SEG_GOOD, "good").when(sil > SEG_OK, "acceptable").otherwise("poor")


def cluster_traits(profile: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Per cluster the first <= 4 variables (of the first 8) whose
    cluster mean is more than 20 % above/below the unweighted mean of the
    cluster means. ``profile`` has one row per cluster with a column per
    variable (E14); output (cluster, variable, value, ref, diff_pct, level, k).
    """
    vs = list(variables)[:TRAIT_MAX_VARS]
    long = profile.select("cluster", F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(v).alias("variable"),
                 F.col(v).cast("double").alias("value")) for i, v in enumerate(vs)]))
        .alias("x")).select("cluster", "x.*")
    # the profile holds k rows: windows over it are bounded
    ref = F.avg("value").over(Window.partitionBy("variable"))
    long = long.withColumn("ref", ref)
    diff = (F.col("value") - F.col("ref")) / F.abs(F.col("ref")) * 100
    t = long.where(F.col("ref") != 0).withColumn("diff_pct", diff).withColumn(
        "level", F.when(F.col("diff_pct") > TRAIT_PCT, "high")
                  .when(F.col("diff_pct") < -TRAIT_PCT, "low")).where(F.col("level").isNotNull())
    w = Window.partitionBy("cluster").orderBy("pos")
    return (t.withColumn("k", F.row_number().over(w)).where(F.col("k") <= TRAIT_MAX_SHOWN)
             .select("cluster", "variable", rnd(F.col("value")).alias("value"),
                     rnd(F.col("ref")).alias("ref"), F.round("diff_pct", 1).alias("diff_pct"),
                     "level", "k"))


def confusion_reading(df: DataFrame, label: str = "label", prediction: str = "prediction",
                      positive: float = 1.0) -> DataFrame:
    """G11 (binary): TP/TN/FP/FN, FP and FN % of all, high-FN and high-FP flags."""
    y = F.col(label).cast("double") == positive
    p = F.col(prediction).cast("double") == positive
    c = df.where(F.col(label).isNotNull()).agg(
        F.count(F.when(y & p, 1)).alias("tp"), F.count(F.when(~y & ~p, 1)).alias("tn"),
        F.count(F.when(~y & p, 1)).alias("fp"), F.count(F.when(y & ~p, 1)).alias("fn"))
    tot = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    return c.select("tp", "tn", "fp", "fn",
                    F.round(F.col("fp") * 100.0 / tot, 1).alias("fp_pct"),
                    F.round(F.col("fn") * 100.0 / tot, 1).alias("fn_pct"),
                    (F.col("fn") > F.col("tp") * 0.3).alias("high_fn"),
                    (F.col("fp") > F.col("tn") * 0.3).alias("high_fp"))


def confusion_reading_multiclass(cm: DataFrame) -> DataFrame:
    """G11 (multi-class): per class recall and precision with max(…, 1)
    denominators, from confusion counts (label, prediction, n)."""
    t = cm.groupBy(F.col("label").alias("class")).agg(
        F.sum("n").alias("total_real"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    p = cm.groupBy(F.col("prediction").alias("class")).agg(F.sum("n").alias("total_pred"))
    j = t.join(p, "class", "left").fillna(0, ["total_pred"])
    return j.select("class", "tp", "total_real", "total_pred",
                    F.round(F.col("tp") / F.greatest(F.col("total_real"), F.lit(1)), 4).alias("recall"),
                    F.round(F.col("tp") / F.greatest(F.col("total_pred"), F.lit(1)), 4).alias("precision"))


def _tiers(c: Column, tiers, default: str, strict: bool = False) -> Column:
    out = None
    for t, name in tiers:
        cond = (c > t) if strict else (c >= t)
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(default)


def metric_reading(metrics: DataFrame, baseline_f1: Column | float | None = None) -> DataFrame:
    """F1 tier, improvement % over the baseline F1 and its tier, the
    precision/recall lean and the AUC tier. ``metrics`` has model, precision,
    recall, f1, auc (and ``baseline_f1`` if not given)."""
    b = F.col("baseline_f1") if baseline_f1 is None else (
        F.lit(baseline_f1) if isinstance(baseline_f1, float) else baseline_f1)
    gain = (F.col("f1") - b) / F.greatest(b, F.lit(0.001)) * 100
    lean = (F.when((F.col("precision") > 0) & (F.col("recall") > 0),
                   F.when(F.col("precision") > F.col("recall") + PR_LEAN, "precise")
                    .when(F.col("recall") > F.col("precision") + PR_LEAN, "sensitive")
                    .otherwise("balanced")))
    return metrics.select(
        "model", "f1", _tiers(F.col("f1"), F1_TIERS, "improvable").alias("f1_tier"),
        F.round(gain, 1).alias("gain_pct"),
        F.when(b.isNull(), None).otherwise(_tiers(gain, GAIN_TIERS, "not_better", strict=True))
        .alias("gain_tier"),
        lean.alias("pr_lean"), _tiers(F.col("auc"), AUC_TIERS, "poor", strict=True).alias("auc_tier"))


def comparison_reading(results: DataFrame) -> DataFrame:
    """best/worst model by F1 (first on ties by name), the F1 gap,
    whether it exceeds 0.1 and whether the best F1 is below 0.9."""
    r = results.agg(
        F.min(F.struct((-F.col("f1")).alias("k"), F.col("model").alias("m")))["m"].alias("best_model"),
        F.max("f1").alias("best_f1"),
        F.min(F.struct(F.col("f1").alias("k"), F.col("model").alias("m")))["m"].alias("worst_model"),
        F.min("f1").alias("worst_f1"))
    gap = F.col("best_f1") - F.col("worst_f1")
    return r.select("best_model", "best_f1", "worst_model", "worst_f1", rnd(gap).alias("f1_gap"),
                    (gap > 0.1).alias("clear_winner"), (F.col("best_f1") < 0.9).alias("tune_advice"))


def recommendations(facts: DataFrame) -> DataFrame:
    """Triggered recommendation ids from a one-row facts table with
    n_rows, null_cells, n_categorical, f1, precision, recall, silhouette
    (NULL when the stage did not run). Emits 'no_issues' when none fires."""
    rules = [
        ("small_dataset", F.col("n_rows") < 500),
        ("nulls_present", F.col("null_cells") > 0),
        ("many_categoricals", F.col("n_categorical") > 10),
        ("low_f1", F.col("f1") < 0.6),
        ("precision_recall_gap", F.abs(F.col("precision") - F.col("recall")) > 0.2),
        ("low_silhouette", F.col("silhouette") < 0.3),
    ]
    long = facts.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(n).alias("rule"),
                 F.coalesce(c, F.lit(False)).alias("fired")) for i, (n, c) in enumerate(rules)]))
        .alias("x")).select("x.*")
    fired = long.where("fired")
    none = long.agg(F.max(F.col("fired").cast("int")).alias("any")).where(F.col("any") == 0).select(
        F.lit(len(rules)).alias("pos"), F.lit("no_issues").alias("rule"), F.lit(True).alias("fired"))
    return fired.unionByName(none).select("pos", "rule")
