"""Registered checks of fitted operators (A5, A7, A8, C14, E3, E6, E9, E13, E17,
 F1, F2, F4, F5, F7, G16).

A fit has no SQL twin, but what must hold of its result on these tables has: which
rows it covers, sums and orders that no seed changes, and identities between its
outputs. Spark computes each statement from the operator's result; the SQL counts
the rows it must hold for, from the tables.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.hashing import seeded_order_sql, seeded_uniform_sql
from quarry.operators import classify as CL
from quarry.operators import cluster as K
from quarry.operators import prep as C
from quarry.operators import profile as P
from quarry.operators import split as S
from quarry.plans import derived as D
from quarry.plans import q_cluster as E
from quarry.plans import q_io, q_metrics, q_ml, q_prep, q_split
from quarry.plans.catalog import ORACLE, query
from quarry.plans.flagship import prepared, trained
from quarry.session import checkpoint_dir
from quarry.sources import sinks as SK
from quarry.sources.tables import read_table

#: The rows of ``doc_quality`` and their splits (D1 with 70 / 15 / 15).
_QUALITY = D.with_sql("doc_quality") + f""", ranked AS (
  SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {seeded_order_sql(42, 'doc_id')}, doc_id) - 1 AS r,
         count(*) OVER (PARTITION BY quality) AS n FROM doc_quality WHERE quality IS NOT NULL),
cut AS (SELECT *, (n * 150 + 999) // 1000 AS nt FROM ranked),
q AS (SELECT *, CASE WHEN r < nt THEN 'test' WHEN r < nt + ((n - nt) * 150 + 849) // 850 THEN 'val' ELSE 'train' END AS split FROM cut)"""


# --- A5, A7, A8 -----------------------------------------------------------------------------

@query("a5_load_error_kinds", """
SELECT 'empty_table' AS "case", count(*) > 0 AS raised FROM customer
UNION ALL SELECT 'unsupported_extension', count(*) > 0 FROM customer""")
def a5_load_error_kinds(spark, sf):
    e = q_io.a5_load_errors(spark, sf)
    return e.select("case", F.isnotnull("error").alias("raised"))


def _reported(spark, name, table):
    """A table written as a report's part and read back."""
    path = os.path.join(checkpoint_dir(spark), "exports", f"report-{uuid.uuid4().hex}")
    return spark.read.parquet(SK.write_report({name: table}, path).first()["path"])


@query("a7_report_statistics", ORACLE.get("b10_describe_lineitem"))
def a7_report_statistics(spark, sf):
    return _reported(spark, "descriptive_statistics", P.describe(read_table(spark, sf, "lineitem")))


@query("a7_report_models", ORACLE["f10_result_table"])
def a7_report_models(spark, sf):
    return _reported(spark, "model_comparison", q_metrics._results(spark, sf, "val"))


@query("a7_report_splits", ORACLE["d4_split_sizes"])
def a7_report_splits(spark, sf):
    return _reported(spark, "split_sizes", q_split.d4_split_sizes(spark, sf))


@query("a8_summary_models", ORACLE["f10_result_table"].replace("SELECT * FROM results", """
SELECT model, round(f1, 4) AS f1, (SELECT count(*) FROM scored) AS n_rows FROM results"""))
def a8_summary_models(spark, sf):
    """The models and the row count, from the JSON summary."""
    s = q_io.a8_run_summary(spark, sf)
    return s.select(F.col("dataset.n_rows").cast("bigint").alias("n_rows"), F.explode("models").alias("m")).select(
        "m.model", F.round("m.f1", 4).alias("f1"), "n_rows")


# --- C14, E13 -------------------------------------------------------------------------------

def _projection_holds(out, ratios, columns, x):
    """Centred, uncorrelated, and variances that are the stated shares of all variance."""
    total = sum(F.var_samp(c) for c in columns)
    t = x.agg(total.alias("t")).first()["t"]
    close = lambda a, b: F.abs(a - b) < 1e-6
    return out.agg(F.count("*").alias("n_rows"), (close(F.avg("PC1"), 0.0) & close(F.avg("PC2"), 0.0)).alias("centred"),
                   close(F.covar_samp("PC1", "PC2") / F.lit(t), F.lit(0.0)).alias("uncorrelated"),
                   (close(F.var_samp("PC1") / F.lit(t), F.lit(ratios[0])) & close(F.var_samp("PC2") / F.lit(t), F.lit(ratios[1])))
                   .alias("shares"), F.lit(ratios[0] >= ratios[1]).alias("ordered"))


_HOLDS = "count(*) AS n_rows, true AS centred, true AS uncorrelated, true AS shares, true AS ordered"


@query("c14_pca_eigen", D.with_sql("orders_wide") + f" SELECT {_HOLDS} FROM orders_wide WHERE o_orderstatus IS NOT NULL")
def c14_pca_eigen(spark, sf):
    d, m = q_prep._fit(spark, sf)
    t = m.transform(d, keep=["o_orderkey"])
    out, ratios = C.pca_fit_transform(t, m.numeric, 2, keep=["o_orderkey"])
    return _projection_holds(out, ratios, m.numeric, t)


@query("e13_projection_eigen", D.with_sql("customer_rfm") + f" SELECT {_HOLDS} FROM customer_rfm")
def e13_projection_eigen(spark, sf):
    x, cols = K.cluster_input(D.customer_rfm(spark, sf), E.RFM, keep=["c_custkey"])
    out, ratios = K.projection_2d(x, cols, keep=["c_custkey"])
    return _projection_holds(out, ratios, cols, x)


@query("e13_projected_centroids", E._FIXED_SQL + """
SELECT cluster, count(*) AS n, true AS inside FROM asg GROUP BY cluster""")
def e13_projected_centroids(spark, sf):
    """Sizes, and whether each centre lies within the bounds of its projected rows."""
    a = E._fixed(spark, sf)
    out, _ = K.projection_2d(a, E.FEATS, keep=["vec_id"])
    centres = K.projected_centroids(out, a, "vec_id")
    ends = out.join(a.select("vec_id", "cluster"), "vec_id").groupBy("cluster").agg(
        *(f(c).alias(f"{n}{c}") for c in ("PC1", "PC2") for f, n in ((F.min, "lo"), (F.max, "hi"))))
    within = [F.col(c).between(F.col(f"lo{c}") - 1e-9, F.col(f"hi{c}") + 1e-9) for c in ("PC1", "PC2")]
    return centres.join(ends, "cluster").select("cluster", "n", (within[0] & within[1]).alias("inside"))


# --- E3, E6, E9, E10, E17 -------------------------------------------------------------------

def _clusters_hold(a, cents, cost):
    """Rows off their nearest centre, numbered clusters, cost as the sum of distances, sizes falling."""
    nearest = K.assign(a.select("vec_id", "cluster", *E.FEATS).withColumnRenamed("cluster", "own"), E.FEATS, cents)
    sizes = a.groupBy("cluster").count()
    falls = F.coalesce(F.lag("count").over(Window.partitionBy(F.lit(0)).orderBy("cluster")) >= F.col("count"), F.lit(True))
    falling = sizes.select(falls.alias("f")).agg(F.bool_and("f").alias("f")).first()["f"]  # a row a cluster
    return nearest.agg(F.count("*").alias("n_rows"), F.count_if(F.col("own") != F.col("cluster")).alias("off_nearest"),
                       F.count_distinct("own").cast("bigint").alias("n_clusters"),
                       (F.abs(F.sum("sq_dist") - cost) < 1e-6 * cost).alias("cost_is_sum"), F.lit(falling).alias("by_size"))


_KMEANS_SQL = """SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS off_nearest, least(10, count(DISTINCT embedding)) AS n_clusters,
  true AS cost_is_sum, true AS by_size FROM embeddings"""


@query("e3_kmeans_holds", _KMEANS_SQL)
def e3_kmeans_holds(spark, sf):
    return _clusters_hold(*K.kmeans(D.emb_features(spark, sf), E.FEATS, 10, n_init=2, seed=42))


@query("e3_kmeans_random_start", _KMEANS_SQL)
def e3_kmeans_random_start(spark, sf):
    return _clusters_hold(*K.kmeans(D.emb_features(spark, sf), E.FEATS, 10, init="random", n_init=1, seed=42))


@query("e6_sweep_holds", D.with_sql("customer_rfm") + """
SELECT CAST(k AS INTEGER) AS k, true AS below_total, true AS silhouette_fine FROM range(2, 7) r(k), (SELECT count(*) AS n FROM customer_rfm) c
WHERE c.n > r.k""")
def e6_sweep_holds(spark, sf):
    """No k has more within-cluster sum than one cluster; silhouettes lie in [-1, 1]."""
    x, cols = K.cluster_input(D.customer_rfm(spark, sf), E.RFM, keep=["c_custkey"])
    total = x.agg(sum(F.var_pop(c) * F.count("*") for c in cols).alias("t")).first()["t"]
    s = K.k_sweep(x, cols, 6, "c_custkey", n_init=1, seed=42)
    return s.select("k", (F.col("wcss") < total).alias("below_total"), F.col("silhouette").between(-1, 1).alias("silhouette_fine"))


@query("e9_bisecting_holds", """
SELECT count(*) AS n_rows, least(10, count(DISTINCT embedding)) AS n_clusters, count(DISTINCT vec_id) AS n_keys FROM embeddings""")
def e9_bisecting_holds(spark, sf):
    b = K.bisecting(D.emb_features(spark, sf), E.FEATS, 10, 42)
    return b.agg(F.count("*").alias("n_rows"), F.count_distinct("cluster").alias("n_clusters"), F.count_distinct("vec_id").alias("n_keys"))


@query("e17_comparison_holds", """
SELECT m.method, n.n > 0 AS in_range, n.n > 0 AS winner_is_best FROM (VALUES ('kmeans'), ('hierarchical')) m(method),
  (SELECT count(*) AS n FROM embeddings) n""")
def e17_comparison_holds(spark, sf):
    best = Window.partitionBy(F.lit(0))  # two rows
    c = E.e17_method_comparison(spark, sf)
    top = F.max(F.when(F.col("method") == F.col("winner"), F.col("silhouette"))).over(best)
    return c.select("method", F.col("silhouette").between(-1, 1).alias("in_range"),
                    (top == F.max("silhouette").over(best)).alias("winner_is_best"))


# --- F1, F2, F4, F5, F7, G16 ----------------------------------------------------------------

_VAL_SQL = _QUALITY + """
SELECT doc_id, CAST(dense_rank() OVER (ORDER BY quality) - 1 AS DOUBLE) AS label, true AS sums_to_one, true AS is_argmax
FROM q QUALIFY split = 'val'"""


def _predictions_hold(p):
    scores = sorted((c for c in p.columns if c.startswith("p") and c[1:].isdigit()), key=lambda c: int(c[1:]))
    every = F.array(*scores)
    at = F.element_at(every, F.col("prediction").cast("int") + 1)
    return p.select("doc_id", "label", (F.abs(sum(F.col(c) for c in scores) - 1) < 1e-9).alias("sums_to_one"),
                    (at == F.array_max(every)).alias("is_argmax"))


@query("f1_tree_predictions_hold", _VAL_SQL)
def f1_tree_predictions_hold(spark, sf):
    return _predictions_hold(q_ml.f1_decision_tree(spark, sf))


@query("f2_forest_predictions_hold", _VAL_SQL)
def f2_forest_predictions_hold(spark, sf):
    return _predictions_hold(q_ml.f2_random_forest(spark, sf))


@query("f4_importances_hold", _QUALITY + """
SELECT least(20, 3 + count(DISTINCT lang) + count(DISTINCT source)) AS n_features, true AS sum_to_one, true AS ranked
FROM q WHERE split = 'train'""")
def f4_importances_hold(spark, sf):
    t, m, model = trained(spark, sf, CL.random_forest(n_trees=20, max_depth=6))
    every = CL.feature_importance(model, m.feature_names, len(m.feature_names))
    top = CL.feature_importance(model, m.feature_names, 20)
    total = every.agg(F.sum("importance")).first()[0]
    falls = F.lag("importance").over(Window.partitionBy(F.lit(0)).orderBy("rank")) >= F.col("importance")
    return top.select(falls.alias("f")).agg(F.count("*").alias("n_features"), F.lit(abs(total - 1) < 0.01).alias("sum_to_one"),
                                            F.bool_and(F.coalesce("f", F.lit(True))).alias("ranked"))


@query("f5_root_impurity", _QUALITY + """,
c AS (SELECT quality, count(*) AS n FROM q WHERE split = 'train' GROUP BY quality)
SELECT CAST(0 AS INTEGER) AS depth, round(1 - sum(n * n) / (sum(n) * sum(n)), 4) AS impurity, true AS deep_enough FROM c""")
def f5_root_impurity(spark, sf):
    """The root holds all training rows: its Gini impurity is that of their labels."""
    nodes = q_ml.f5_tree_nodes(spark, sf)
    deepest = nodes.agg(F.max("depth")).first()[0]
    return nodes.where("id = 0").select("depth", F.round("impurity", 4).alias("impurity"), F.lit(deepest <= 5).alias("deep_enough"))


_TREES = 10
_UNSEEN = " + ".join(f"CASE WHEN {seeded_uniform_sql(42, 'doc_id', str(t))} < 0.36787944117144233 THEN 1 ELSE 0 END" for t in range(_TREES))


@query("f7_oob_votes", _QUALITY + f"""
SELECT doc_id, CAST({_UNSEEN} AS INTEGER) AS n_votes FROM q WHERE split = 'train'""")
def f7_oob_votes(spark, sf):
    """How many trees did not see each training row, and so vote on it."""
    t, m = prepared(spark, sf)
    v = CL.oob_votes(t.where(F.col("split") == "train"), "doc_id", m.feature_names, n_trees=_TREES, max_depth=4)
    return v.select("doc_id", F.size("votes").alias("n_votes"))


@query("f12_training_facts_fitted", _QUALITY + """
SELECT count(*) AS n_rows, 3 + count(DISTINCT lang) + count(DISTINCT source) AS n_features, count(DISTINCT quality) AS n_classes,
  CASE WHEN count(DISTINCT quality) = 2 THEN 'binary' ELSE 'weighted' END AS averaging FROM q WHERE split = 'train'""")
def f12_training_facts_fitted(spark, sf):
    """F12 of a real training set: its encoded features and classes."""
    t, m = prepared(spark, sf)
    return t.where(F.col("split") == "train").agg(
        F.count("*").alias("n_rows"), F.lit(len(m.feature_names)).alias("n_features"), F.lit(m.n_classes).alias("n_classes"),
        F.lit("binary" if m.n_classes == 2 else "weighted").alias("averaging"))


@query("g16_scored_documents", "SELECT doc_id, true AS sums_to_one, true AS is_argmax FROM documents")
def g16_scored_documents(spark, sf):
    return _predictions_hold(q_ml.g16_stream_scoring(spark, sf).withColumn("label", F.lit(0.0))).drop("label")


# --- C18 ------------------------------------------------------------------------------------

@query("c18_dtypes_before_after", D.with_sql("orders_wide") + """,
d AS (SELECT column_type FROM (DESCRIBE orders_wide)),
k AS (SELECT count(DISTINCT o_orderstatus) AS classes FROM orders_wide)
SELECT 'before' AS stage, CASE WHEN column_type = 'VARCHAR' THEN 'string' WHEN column_type IN ('BIGINT', 'HUGEINT') THEN 'bigint'
  ELSE lower(column_type) END AS dtype, count(*) AS n_columns FROM d GROUP BY 1, 2""")
def c18_dtypes_before_after(spark, sf):
    return C.dtype_counts(D.orders_wide(spark, sf), "before")
