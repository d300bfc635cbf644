"""Range-partitioned ranks, cuts and curves against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.functions import ranking as R
from quarry.operators import metrics as M
from quarry.operators import split as S


@pytest.fixture(scope="module")
def hot(spark):
    """60 % of the rows hold one order value, of a string column."""
    return spark.range(5000).select("id", F.when(F.col("id") % 10 < 6, "same").otherwise(
        F.concat(F.lit("x"), F.col("id") % 1000)).alias("o"), (F.col("id") % 3).cast("string").alias("g"))


def test_equal_order_values_are_spread(hot):
    parts = R.ranged(hot, [F.col("o"), F.col("id")], 8).groupBy("_bkt").count().collect()
    assert len(parts) == 8 and max(r["count"] for r in parts) < 5000 / 4


def test_ranks_with_ties_and_groups(spark, hot):
    rows = sorted(((r.g, r.o, r.id, r.rank0) for r in R.row_rank(hot, ["g"], "o", tie_breaker=["id"]).collect()))
    for g in "012":
        own = [r for r in rows if r[0] == g]
        assert [r[3] for r in own] == list(range(len(own)))
    table = spark.createDataFrame([(None, 1), (None, 2), ("b", 4), (None, 8), ("a", 16)], "g string, w int")
    sums = R.running_sums(table, ["g"], "w", ["w"], inclusive_ties=False, descending=True, next_cols=["w"])
    assert {(r.w, r.cum_w, r.before_w, r.next_w) for r in sums.collect()} == {
        (8, 8, 0, 2), (2, 10, 8, 1), (1, 11, 10, None), (4, 4, 0, None), (16, 16, 0, None)}
    ties = R.running_sums(hot.withColumn("w", F.lit(1)), [], "o", ["w"])
    assert {(r.cum_w, r.before_w) for r in ties.where("o = 'same'").collect()} == {(3000, 0)}
    assert R.row_rank(hot.limit(0), ["g"], "o").count() == 0


def test_ordered_split_is_exact(spark, hot):
    plan = S.SplitPlan(70, 50)
    found = {r.id: r.split for r in S.ordered_split(hot, "o", plan, ["id"]).collect()}
    order = [r.id for r in sorted(hot.collect(), key=lambda r: (r.o, r.id))]
    assert [found[i] for i in order] == ["train"] * 3500 + ["val"] * 750 + ["test"] * 750
    # no tie-breaker, NULLs first, names that clash with ours
    rows = [(None, 1), (2.5, 2), (None, 3), (1.5, 4), (float("nan"), 5), (2.5, 6), (-1.0, 7), (0.0, 8), (9.0, 9), (9.0, 10)]
    out = S.ordered_split(spark.createDataFrame(rows, "_k0 double, _h int"), "_k0", plan)
    of = {r["_h"]: r["split"] for r in out.collect()}
    assert out.columns == ["_k0", "_h", "split"] and sorted(of.values()) == ["test"] * 2 + ["train"] * 6 + ["val"] * 2
    assert {of[i] for i in (1, 3, 7, 8, 4)} == {"train"} and of[5] == "test"
    assert S.ordered_split(hot.limit(0), "o", plan).count() == 0


def test_sorted_codes(spark, hot):
    codes = {(r.g, r.o): r.code for r in R.sorted_codes(hot, ["g"], "o").collect()}
    for g in "012":
        own = sorted({r.o for r in hot.collect() if r.g == g})
        assert [codes[g, o] for o in own] == list(range(len(own)))


def curve(rows):
    """(threshold, fpr, tpr) of (pos, score) rows, without points on a straight line."""
    scores = sorted({s for _, s in rows}, reverse=True)
    tps = np.cumsum([sum(p for p, t in rows if t == s) for s in scores])
    fps = np.cumsum([sum(not p for p, t in rows if t == s) for s in scores])
    keep = np.concatenate([[True], (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0), [True]]) if len(scores) > 1 else [True]
    return [(None, 0.0, 0.0)] + [(s, f / fps[-1], t / tps[-1]) for s, f, t, k in zip(scores, fps, tps, keep) if k]


def straight(n, seed):
    """Scores in long runs of the same sign, one row each, with some ties."""
    rng, rows, s = random.Random(seed), [], 1.0
    while len(rows) < n:
        pos = rng.random() < 0.5
        for _ in range(rng.randrange(1, 60)):
            rows.append((pos, round(s, 6)))
            s -= rng.choice([0.001, 0.001, 0.001, 0.0])
    return rows + [(True, round(s, 6)), (False, round(s - 1, 6))]


def test_curve_without_straight_points(spark):
    rows = straight(800, 1)
    table = spark.createDataFrame(rows, "pos boolean, s double").select(F.lit("c").alias("class"), "pos", "s")
    found = sorted(map(tuple, M.roc_points(table).select("threshold", "fpr", "tpr").collect()), key=lambda r: (r[1], r[2]))
    want = sorted(curve(rows), key=lambda r: (r[1], r[2]))
    assert len(found) < len({s for _, s in rows}) / 2
    assert [r[0] for r in found] == [r[0] for r in want]
    assert np.allclose([r[1:] for r in found], [r[1:] for r in want])


def test_macro_curve_of_many_classes(spark):
    rng = random.Random(4)
    rows = [(c, p, s) for c in range(300) for p, s in straight(rng.randrange(2, 40), c)]
    rows += [(1000, True, 0.5), (1001, False, 0.25)]  # alone: no curve
    table = spark.createDataFrame(rows, "class int, pos boolean, s double")
    points, auc = M.macro_curve(table, 5)
    curves = [curve([(p, s) for k, p, s in rows if k == c]) for c in range(300)]
    grid = np.unique([f for own in curves for _, f, _ in own])
    mean = np.mean([np.interp(grid, [p[1] for p in own], [p[2] for p in own]) for own in curves], axis=0)
    found = sorted(map(tuple, points.collect()))
    assert np.allclose(found, np.round(np.stack([grid, mean], axis=1), 4), atol=1.1e-4)
    assert auc.first()[0] == pytest.approx(np.trapezoid(mean, grid), abs=1e-4)


def test_cv_comparison(spark):
    results = spark.createDataFrame([("base", 0.4), ("tree", 0.5)], "model string, f1 double")
    folds = spark.createDataFrame([("tree", 0, 0.6), ("tree", 1, 0.8)], "model string, fold int, f1 double")
    assert sorted(map(tuple, M.cv_comparison(results, folds).collect())) == [("base", 0.4, 0.0), ("tree", 0.7, 0.1)]


def test_confusion_matrix_fills_up(spark):
    rows = [(0.0, 0.0), (0.0, 1.0), (2.0, 2.0), (2.0, 2.0), (None, 1.0)]
    found = {(r.label, r.prediction): (r["count"], r.pct) for r in M.confusion_matrix(
        spark.createDataFrame(rows, "label double, prediction double")).collect()}
    assert len(found) == 9 and found[2.0, 2.0] == (2, 50.0) and found[1.0, 1.0] == (0, 0.0)
