"""Registered model-training queries.

Fits are iterative ML: rows-only checks, except the class weights (F3)
which are pure SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import classify as CL
from quarry.operators import metrics as M
from quarry.operators import split as S
from quarry.plans import derived as D
from quarry.plans.catalog import query
from quarry.plans.flagship import flagship, prepared, trained
from quarry.sources.tables import read_table, stream_table


@query("f3_class_weights", """
SELECT o_orderstatus AS class, count(*) AS n,
       CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)) AS weight
FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY o_orderstatus""")
def f3_class_weights(spark, sf):
    return CL.class_weights(read_table(spark, sf, "orders"), "o_orderstatus")


def _val_predictions(spark, sf, est):
    t, m, model = trained(spark, sf, est)
    k = m.n_classes
    return CL.predict(model, t.where(F.col("split") == "val"), m.feature_names, k, keep=["doc_id"])


@query("f1_decision_tree")
def f1_decision_tree(spark, sf):
    return _val_predictions(spark, sf, CL.decision_tree(max_depth=5, criterion="entropy",
                                                        min_split=4, min_leaf=2))


@query("f1_decision_tree_sqrt_features")
def f1_decision_tree_sqrt_features(spark, sf):
    return _val_predictions(spark, sf, CL.decision_tree(max_depth=5, max_features="sqrt",
                                                        class_weight="balanced"))


@query("f2_random_forest")
def f2_random_forest(spark, sf):
    return _val_predictions(spark, sf, CL.random_forest(n_trees=50, max_depth=8,
                                                        class_weight="balanced"))


@query("f4_feature_importance")
def f4_feature_importance(spark, sf):
    t, m, model = trained(spark, sf, CL.random_forest(n_trees=50, max_depth=8))
    return CL.feature_importance(model, m.feature_names, 20)


@query("f5_tree_nodes")
def f5_tree_nodes(spark, sf):
    t, m, model = trained(spark, sf, CL.decision_tree(max_depth=6))
    return CL.tree_nodes(model, m.feature_names, 5)


@query("f6_cv_scores")
def f6_cv_scores(spark, sf):
    t, m = prepared(spark, sf)
    tr = S.stratified_folds(t.where(F.col("split") == "train"), "doc_id", "label", 5, 42)
    classes = [float(i) for i in range(m.n_classes)]
    return CL.cross_validate(lambda: CL.decision_tree(max_depth=5), tr, m.feature_names,
                             "fold", 5, "f1", classes)


@query("f7_oob_accuracy")
def f7_oob_accuracy(spark, sf):
    t, m = prepared(spark, sf)
    return CL.oob_accuracy(t.where(F.col("split") == "train"), "doc_id", m.feature_names,
                           n_trees=10, max_depth=8)


@query("f10_model_results_trained")
def f10_model_results_trained(spark, sf):
    t, m = prepared(spark, sf)
    k = m.n_classes
    classes = [float(i) for i in range(k)]
    scores = [f"p{i}" for i in range(k)]
    val = t.where(F.col("split") == "val")
    longs = []
    base_classes = S.fit_baseline(t.where(F.col("split") == "train"), "label")
    b = S.baseline_predict(val, "doc_id", base_classes, "stratified", 42)
    longs.append(M.metrics_long(b, "baseline", label="label", prediction="prediction",
                                classes=classes))
    for name, est in (("decision_tree", CL.decision_tree(max_depth=5)),
                      ("random_forest", CL.random_forest(n_trees=50, max_depth=8))):
        model = CL.fit(est, t.where(F.col("split") == "train"), m.feature_names)
        p = CL.predict(model, val, m.feature_names, k)
        longs.append(M.metrics_long(p, name, label="label", prediction="prediction",
                                    score_cols=scores, classes=classes))
    out = longs[0]
    for x in longs[1:]:
        out = out.unionByName(x)
    return M.result_table(out)


@query("g10_final_test_trained")
def g10_final_test_trained(spark, sf):
    return flagship(spark, sf)


@query("g16_stream_scoring")
def g16_stream_scoring(spark, sf):
    """Score every document through an availableNow stream with the
    pipeline fitted on the labelled training rows."""
    from quarry.streaming.scoring import score_stream
    t, m, model = trained(spark, sf)

    def prep_docs(s):
        return s.select("doc_id", F.col("n_chars").cast("double").alias("n_chars"),
                        F.size(F.split(F.trim("text"), r"\s+")).cast("double").alias("words"),
                        F.size(F.split("text", "\n")).cast("double").alias("lines"),
                        "lang", "source")
    return score_stream(spark, stream_table(spark, sf, "documents"), m, model, keep=["doc_id"], prepare=prep_docs)
