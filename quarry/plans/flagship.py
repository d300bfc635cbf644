"""Flagship pipeline: profile -> stratified split -> fit preparation on
train -> decision tree -> metrics on the test split (documents ⨝ labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import classify as CL
from quarry.operators import metrics as M
from quarry.operators import prep as C
from quarry.operators import profile as P
from quarry.operators import split as S
from quarry.plans import derived as D
from quarry.session import cut_lineage

TARGET = "quality"


def prepared(spark: SparkSession, sf: str, seed: int = 42):
    """Split + fitted preparation of ``doc_quality``.
    Returns (transformed frame with split, PrepModel)."""
    d = D.doc_quality(spark, sf)
    # the split (join + bucketed ranks) feeds every later pass: write it once
    sp = cut_lineage(S.stratified_split(d, "doc_id", TARGET, S.SplitPlan(70, 50), seed))
    prof = P.collect_profile(sp.where(F.col("split") == "train").drop("split"))
    spec = C.PrepSpec(target=TARGET, exclude=("doc_id", "split"), scaler="standard",
                      encoder="onehot")
    m = C.fit_prep(sp, spec, prof=prof, train_filter=F.col("split") == "train")
    t = m.transform(sp, keep=["doc_id", "split"])
    return t, m


def trained(spark: SparkSession, sf: str, estimator=None, seed: int = 42):
    t, m = prepared(spark, sf, seed)
    est = estimator or CL.decision_tree(max_depth=5, seed=seed)
    feats = m.feature_names
    t = t.toDF(*[c for c in t.columns])
    model = CL.fit(est, t.where(F.col("split") == "train"), feats)
    return t, m, model


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    t, m, model = trained(spark, sf)
    k = m.n_classes
    test = CL.predict(model, t.where(F.col("split") == "test"), m.feature_names, k, keep=["doc_id"])
    met = M.classification_metrics(test, "label", "prediction", [f"p{i}" for i in range(k)],
                                   [float(i) for i in range(k)])
    return met.select(F.lit("decision_tree").alias("model"), F.lit("test").alias("split"), "*")
