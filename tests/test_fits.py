"""Merges on Spark and out-of-bag votes against plain loops; dictionaries and vectors."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import classify as CL
from quarry.operators import cluster as K
from quarry.operators import prep as C


@pytest.mark.parametrize("method", ["ward", "average", "complete", "single"])
def test_merges_equal_one_by_one(spark, method):
    rng = np.random.default_rng(3)
    x, w = rng.normal(size=(18, 3)), rng.integers(1, 9, 18).astype(float)
    x[1] = x[0]  # a distance of 0
    points = spark.createDataFrame([(i, float(w[i]), x[i].tolist()) for i in range(18)], "id long, weight double, x array<double>")
    found = K.merge_table(points, method).orderBy("step").collect()
    want = K._linkage(x, w, method)
    assert [{r.left, r.right} for r in found] == [{a, b} for a, b, _, _ in want]
    assert np.allclose([r.height for r in found], [h for _, _, h, _ in want]) and found[-1]["size"] == int(w.sum())
    assert K.merge_table(points.where("id = 0"), method).count() == 0


def test_oob_votes_are_those_of_unseen_trees(spark):
    rows = [(i, float(i % 2), float(i % 2) + i * 1e-3, float(i % 7)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label double, a double, b double")
    votes = CL.oob_votes(df, "id", ["a", "b"], n_trees=5, max_depth=3, max_features="all").collect()
    assert len(votes) == 200 and 0.25 < sum(len(r.votes) for r in votes) / 1000 < 0.5
    accuracy = CL.oob_accuracy(df, "id", ["a", "b"], n_trees=5, max_depth=3, max_features="all").first()
    seen = [r for r in votes if r.votes]
    right = sum(min(set(r.votes), key=lambda c: (-r.votes.count(c), c)) == r.label for r in seen)
    assert accuracy.n_oob_rows == len(seen) and accuracy.oob_accuracy == pytest.approx(right / len(seen), abs=1e-4)


def test_vectors_of_many_categories(spark):
    train = spark.range(3000).select(F.col("id"), F.concat(F.lit("v"), F.lpad("id", 5, "0")).alias("c"),
                                     (F.col("id") % 3).cast("string").alias("t"), F.col("id").cast("double").alias("x"))
    from quarry.operators.profile import TableProfile
    prof = TableProfile(n_rows=3000, roles={"c": "categorical", "x": "numeric", "t": "categorical", "id": "id_like"}, n_unique={},
                        null_pct={}, dtypes={"c": "string", "x": "double", "t": "string", "id": "bigint"}, order=["id", "c", "x", "t"])
    m = C.fit_prep(train, C.PrepSpec(target="t", exclude=("id",), scaler="none"), prof=prof)
    assert m.sizes == {"c": 3000, None: 3}
    new = spark.createDataFrame([(1, "v00007", "2", 5.0), (2, "zz", "0", None), (3, None, None, 1.0), (4, "v02999", "9", 2.0)],
                                "id long, c string, t string, x double")
    got = {r.id: r for r in m.vectors(new, keep=["id"]).collect()}
    assert set(got) == {1, 2} and got[1].label == 2.0  # rows of unknown class have no label
    assert got[1].features.size == 3001 and dict(zip(got[1].features.indices, got[1].features.values)) == {0: 5.0, 8: 1.0}
    assert list(got[2].features.indices) in ([0], []) and len(m.vectors(new, with_label=False).collect()) == 4
    small = len(m.vectors(new)._jdf.queryExecution().optimizedPlan().toString())
    assert small < 20_000  # the plan does not hold the categories
