import pytest
from pyspark.sql import functions as F

from quarry.operators import metrics as M
from quarry.operators import insights as I


def test_auc6(spark):
    rows = [(0.0, .1), (0.0, .4), (1.0, .4), (1.0, .8), (0.0, .8), (1.0, .9)]
    df = spark.createDataFrame(rows, "label double, s double")
    assert M.binary_auc(df, "label", "s").first()["auc"] == pytest.approx(0.7778, abs=1e-4)


def _cm3(spark):
    cm = [[5, 1, 0], [2, 3, 1], [0, 0, 4]]
    rows = []
    for i in range(3):
        for j in range(3):
            rows += [(float(i), float(j))] * cm[i][j]
    return spark.createDataFrame(rows, "label double, prediction double")


def test_cm3_weighted(spark):
    r = M.classification_metrics(_cm3(spark), classes=[0.0, 1.0, 2.0]).first()
    assert r["accuracy"] == 0.75
    assert r["precision"] == pytest.approx(0.7491, abs=1e-4)
    assert r["recall"] == 0.75 and r["f1"] == pytest.approx(0.7357, abs=1e-4)
    rep = {x["row"]: x for x in M.classification_report(_cm3(spark)).collect()}
    assert [rep[k]["f1"] for k in ("0.0", "1.0", "2.0")] == pytest.approx([0.7692, 0.6, 0.8889], abs=1e-4)
    top = M.top_errors(_cm3(spark)).orderBy("rank").first()
    assert (top["label"], top["prediction"], top["count"]) == (1.0, 0.0, 2)


def test_confusion_matrix_complete(spark):
    cm = M.confusion_matrix(_cm3(spark))
    assert cm.count() == 9 and cm.agg({"count": "sum"}).first()[0] == 16


def test_roc_auc_matches_trapezoid(spark):
    rows = [(0.0, .1), (0.0, .4), (1.0, .4), (1.0, .8), (0.0, .8), (1.0, .9)]
    df = spark.createDataFrame(rows, "label double, s double")
    pts = sorted((r["fpr"], r["tpr"]) for r in M.binary_roc(df, "label", "s").collect())
    auc = sum((x1 - x0) * (y0 + y1) / 2 for (x0, y0), (x1, y1) in zip(pts, pts[1:]))
    assert auc == pytest.approx(0.7778, abs=1e-3)


def test_recommendations_default(spark):
    f = spark.createDataFrame([(1000, 0, 0, 0.9, 0.9, 0.9, 0.5)],
                              "n_rows long, null_cells long, n_categorical int, f1 double, "
                              "precision double, recall double, silhouette double")
    assert [r["rule"] for r in I.recommendations(f).collect()] == ["no_issues"]


@pytest.mark.parametrize("classes", [[0.0, 1.0], [0.0, 1.0, 2.0]])
def test_grouped_metrics_equal_per_group(spark, classes):
    k = len(classes)
    rows = [(m, float(i % k), float((i * 7 + len(m)) % k), *[((i * (j + 3)) % 11) / 10.0 for j in range(k)])
            for m in ("a", "bb", "ccc") for i in range(300)]
    df = spark.createDataFrame(rows, "model string, label double, prediction double, "
                               + ", ".join(f"p{j} double" for j in range(k)))
    scores = [f"p{j}" for j in range(k)]
    got = {r["model"]: tuple(r[m] for m in M.METRICS) for r in
           M.classification_metrics(df, "label", "prediction", scores, classes, groups=["model"]).collect()}
    for m in ("a", "bb", "ccc"):
        one = M.classification_metrics(df.where(F.col("model") == m), "label", "prediction",
                                       scores, classes).first()
        assert got[m] == tuple(one[x] for x in M.METRICS)
