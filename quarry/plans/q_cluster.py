"""Registered clustering queries.

The exact core (assignment, inertia, sizes, profiles, traits, silhouette) is
checked against a fixed centroid table – the per-label means of the
embeddings – so it needs no fitted model; the fits (K-Means, sweep,
hierarchies, projection) are rows-only checks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.hashing import seeded_order_sql
from quarry.operators import cluster as K
from quarry.operators import insights as I
from quarry.plans import derived as D
from quarry.plans.catalog import query
from quarry.sources.tables import read_table

FEATS = D.FEATS
PROF8 = FEATS[:8]
RFM = ["n_orders", "total_spent", "last_order_days", "c_acctbal"]
_EMB = D.with_sql("emb_features")


def _fixed(spark, sf):
    e = D.emb_features(spark, sf)
    ids, cents = K.group_centroids(e, FEATS, "label")
    return K.assign(e, FEATS, cents, ids)


_FIXED_SQL = _EMB + f""", lf AS (UNPIVOT emb_features ON {', '.join(FEATS)} INTO NAME dim VALUE v),
cen AS (SELECT label AS cluster, dim, avg(v) AS m FROM lf GROUP BY label, dim),
dist AS (SELECT lf.vec_id, cen.cluster, sum((lf.v - cen.m) * (lf.v - cen.m)) AS d
         FROM lf JOIN cen ON lf.dim = cen.dim GROUP BY lf.vec_id, cen.cluster),
asg AS (SELECT e.*, a.cluster, a.sq_dist FROM emb_features e JOIN (
          SELECT vec_id, arg_min(cluster, d) AS cluster, min(d) AS sq_dist FROM dist GROUP BY vec_id) a
        ON e.vec_id = a.vec_id)"""


# --- E1 / E2 -----------------------------------------------------------------------------

@query("e1_cluster_input", D.with_sql("customer_rfm") + """,
med AS (SELECT """ + ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in RFM) + """ FROM customer_rfm),
imp AS (SELECT c_custkey, """ + ", ".join(f"coalesce({c}, m_{c}) AS {c}" for c in RFM) + """ FROM customer_rfm, med),
st AS (SELECT """ + ", ".join(f"avg({c}) AS a_{c}, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1.0 END AS s_{c}"
                            for c in RFM) + """ FROM imp)
SELECT c_custkey, """ + ", ".join(f"round((imp.{c} - a_{c}) / s_{c}, 4) + 0.0 AS {c}" for c in RFM) + " FROM imp, st")
def e1_cluster_input(spark, sf):
    x, cols = K.cluster_input(D.customer_rfm(spark, sf), RFM, keep=["c_custkey"])
    return x.select("c_custkey", *[F.round(c, 4).alias(c) for c in cols])


@query("e2_sample", D.with_sql("customer_rfm") + f"""
SELECT c_custkey FROM customer_rfm ORDER BY {seeded_order_sql(42, 'c_custkey')}, c_custkey LIMIT 1000""")
def e2_sample(spark, sf):
    return K.sample_rows(D.customer_rfm(spark, sf), "c_custkey", 1000, 42).select("c_custkey")


# --- E4 / E11 / E14 / E15 / E16 on the fixed centroids ---------------------------------

@query("e4_inertia_fixed", _FIXED_SQL + "\nSELECT round(sum(sq_dist), 4) AS wcss FROM asg")
def e4_inertia_fixed(spark, sf):
    return K.inertia(_fixed(spark, sf))


@query("e4_assignment_fixed", _FIXED_SQL + "\nSELECT vec_id, cluster FROM asg")
def e4_assignment_fixed(spark, sf):
    return _fixed(spark, sf).select("vec_id", "cluster")


@query("e11_cluster_sizes", _FIXED_SQL + """
SELECT cluster, count(*) AS n, round(CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (), 2) AS pct
FROM asg GROUP BY cluster""")
def e11_cluster_sizes(spark, sf):
    return K.cluster_sizes(_fixed(spark, sf))


_PROFILE_SQL = _FIXED_SQL + """,
prof AS (SELECT cluster, count(*) AS n_members, """ + ", ".join(
    f"round(avg({c}), 3) AS {c}, round(stddev_samp({c}), 3) AS {c}_std" for c in PROF8) + """
  FROM asg GROUP BY cluster)"""


@query("e14_cluster_profile", _PROFILE_SQL + "\nSELECT * FROM prof")
def e14_cluster_profile(spark, sf):
    return K.cluster_profile(_fixed(spark, sf), PROF8)


@query("e15_normalised_profile", _PROFILE_SQL + "\nSELECT cluster, " + ", ".join(
    f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-10), 4) + 0.0 AS {c}"
    for c in PROF8) + " FROM prof")
def e15_normalised_profile(spark, sf):
    return K.normalised_profile(K.cluster_profile(_fixed(spark, sf), PROF8), PROF8)


@query("e16_cluster_traits", _PROFILE_SQL + """,
lg AS (""" + " UNION ALL ".join(f"SELECT cluster, {i} AS pos, '{c}' AS variable, {c} AS value FROM prof"
                               for i, c in enumerate(PROF8)) + """),
r AS (SELECT *, avg(value) OVER (PARTITION BY variable) AS ref FROM lg),
t AS (SELECT *, (value - ref) / abs(ref) * 100 AS diff_pct FROM r WHERE ref <> 0),
l AS (SELECT *, CASE WHEN diff_pct > 20 THEN 'high' WHEN diff_pct < -20 THEN 'low' END AS level FROM t)
SELECT cluster, variable, round(value, 4) + 0.0 AS value, round(ref, 4) + 0.0 AS ref, round(diff_pct, 1) + 0.0 AS diff_pct, level,
       CAST(k AS INTEGER) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY pos) AS k FROM l WHERE level IS NOT NULL) z WHERE k <= 4""")
def e16_cluster_traits(spark, sf):
    return I.cluster_traits(K.cluster_profile(_fixed(spark, sf), PROF8), PROF8)


# --- the same of all features

_PROFILE_ALL_SQL = _FIXED_SQL + """,
prof AS (SELECT cluster, count(*) AS n_members, """ + ", ".join(
    f"round(avg({c}), 3) AS {c}, round(stddev_samp({c}), 3) AS {c}_std" for c in FEATS) + """
  FROM asg GROUP BY cluster)"""


@query("e14_cluster_profile_all", _PROFILE_ALL_SQL + "\nSELECT * FROM prof")
def e14_cluster_profile_all(spark, sf):
    return K.cluster_profile(_fixed(spark, sf), FEATS)


@query("e15_normalised_profile_all", _PROFILE_ALL_SQL + "\nSELECT cluster, " + ", ".join(
    f"round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-10), 4) + 0.0 AS {c}"
    for c in FEATS) + " FROM prof")
def e15_normalised_profile_all(spark, sf):
    return K.normalised_profile(K.cluster_profile(_fixed(spark, sf), FEATS), FEATS)


@query("e16_cluster_traits_all", _PROFILE_ALL_SQL + """,
lg AS (""" + " UNION ALL ".join(f"SELECT cluster, {i} AS pos, '{c}' AS variable, {c} AS value FROM prof"
                               for i, c in enumerate(FEATS)) + """),
r AS (SELECT *, avg(value) OVER (PARTITION BY variable) AS ref FROM lg),
t AS (SELECT *, (value - ref) / abs(ref) * 100 AS diff_pct FROM r WHERE ref <> 0),
l AS (SELECT *, CASE WHEN diff_pct > 20 THEN 'high' WHEN diff_pct < -20 THEN 'low' END AS level FROM t)
SELECT cluster, variable, round(value, 4) + 0.0 AS value, round(ref, 4) + 0.0 AS ref, round(diff_pct, 1) + 0.0 AS diff_pct, level,
       CAST(k AS INTEGER) AS k FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY pos) AS k FROM l WHERE level IS NOT NULL) z WHERE k <= 4""")
def e16_cluster_traits_all(spark, sf):
    return I.cluster_traits(K.cluster_profile(_fixed(spark, sf), FEATS), FEATS)


# --- E5 / E12 silhouette -----------------------------------------------------------------

_SIL_SQL = _FIXED_SQL + f""",
smp AS (SELECT vec_id, cluster FROM asg ORDER BY {seeded_order_sql(42, 'vec_id')}, vec_id LIMIT 2000),
sl AS (SELECT s.vec_id, s.cluster, lf.dim, lf.v FROM smp s JOIN lf ON s.vec_id = lf.vec_id),
pd AS (SELECT a.vec_id AS i, a.cluster AS ci, b.vec_id AS j, b.cluster AS cj, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d
       FROM sl a JOIN sl b ON a.dim = b.dim GROUP BY a.vec_id, a.cluster, b.vec_id, b.cluster),
cs AS (SELECT cluster, count(*) AS n FROM smp GROUP BY cluster),
per AS (SELECT i, ci, cj, sum(d) AS sd FROM pd GROUP BY i, ci, cj),
ab AS (SELECT p.i, p.ci,
          max(CASE WHEN p.cj = p.ci AND c.n > 1 THEN p.sd / (c.n - 1) WHEN p.cj = p.ci THEN 0.0 END) AS a,
          min(CASE WHEN p.cj <> p.ci THEN p.sd / c.n END) AS b,
          max(CASE WHEN p.cj = p.ci THEN c.n END) AS own_n
       FROM per p JOIN cs c ON p.cj = c.cluster GROUP BY p.i, p.ci),
s AS (SELECT i, CASE WHEN own_n = 1 OR b IS NULL THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


@query("e5_silhouette_fixed", _SIL_SQL + "\nSELECT round(avg(s), 4) AS silhouette FROM s")
def e5_silhouette_fixed(spark, sf):
    return K.silhouette(_fixed(spark, sf), "vec_id", FEATS).select(
        F.round("silhouette", 4).alias("silhouette"))


@query("e12_segmentation_grade", _SIL_SQL + """
SELECT round(avg(s), 4) AS silhouette,
  CASE WHEN avg(s) > 0.5 THEN 'good' WHEN avg(s) > 0.3 THEN 'acceptable' ELSE 'poor' END AS grade FROM s""")
def e12_segmentation_grade(spark, sf):
    s = K.silhouette(_fixed(spark, sf), "vec_id", FEATS)
    return s.select(F.round("silhouette", 4).alias("silhouette"),
                    I.segmentation_grade(F.col("silhouette")).alias("grade"))


# --- the squared form over all rows (no sample) ---------------------------------------------

# The mean squared distance of a row to a cluster follows from the cluster's sums of x and |x|^2.
_SQ_SQL = _FIXED_SQL + """,
lc AS (SELECT a.vec_id, a.cluster, lf.dim, lf.v FROM asg a JOIN lf ON lf.vec_id = a.vec_id),
y AS (SELECT cluster, dim, sum(v) AS y FROM lc GROUP BY cluster, dim),
c AS (SELECT cluster, count(DISTINCT vec_id) AS n, sum(v * v) AS psi FROM lc GROUP BY cluster),
x AS (SELECT vec_id, cluster, sum(v * v) AS xi FROM lc GROUP BY vec_id, cluster),
xy AS (SELECT lc.vec_id, y.cluster AS other, sum(lc.v * y.y) AS dot FROM lc JOIN y ON y.dim = lc.dim GROUP BY lc.vec_id, y.cluster),
far AS (SELECT x.vec_id, x.cluster, xy.other, c.n, x.xi + c.psi / c.n - 2 * xy.dot / c.n AS d
        FROM x JOIN xy ON xy.vec_id = x.vec_id JOIN c ON c.cluster = xy.other),
ab AS (SELECT vec_id, max(CASE WHEN other = cluster THEN n END) AS n,
              max(CASE WHEN other = cluster AND n > 1 THEN d * n / (n - 1) ELSE NULL END) AS a,
              min(CASE WHEN other <> cluster THEN d END) AS b FROM far GROUP BY vec_id),
s AS (SELECT CASE WHEN n = 1 OR b IS NULL OR a = b THEN 0.0 ELSE (b - a) / greatest(a, b) END AS s FROM ab)"""


@query("e5_silhouette_full", _SQ_SQL + "\nSELECT round(avg(s), 4) AS silhouette_sq FROM s")
def e5_silhouette_full(spark, sf):
    return K.silhouette_sq_full(_fixed(spark, sf), FEATS).select(F.round("silhouette_sq", 4).alias("silhouette_sq"))


@query("e12_segmentation_grade_full", _SQ_SQL + """
SELECT round(avg(s), 4) AS silhouette_sq,
  CASE WHEN avg(s) > 0.5 THEN 'good' WHEN avg(s) > 0.3 THEN 'acceptable' ELSE 'poor' END AS grade FROM s""")
def e12_segmentation_grade_full(spark, sf):
    return K.silhouette_sq_full(_fixed(spark, sf), FEATS).select(
        F.round("silhouette_sq", 4).alias("silhouette_sq"), I.segmentation_grade(F.col("silhouette_sq")).alias("grade"))


# --- fitted (rows-only) --------------------------------------------------------------------

@query("e3_kmeans")
def e3_kmeans(spark, sf):
    a, cents, cost = K.kmeans(D.emb_features(spark, sf), FEATS, 10, n_init=3, seed=42)
    return a.select("vec_id", "cluster", "sq_dist")


def _sweep(spark, sf):
    x, cols = K.cluster_input(D.customer_rfm(spark, sf), RFM, keep=["c_custkey"])
    return K.k_sweep(x, cols, 6, "c_custkey", n_init=1, seed=42)


@query("e6_k_sweep")
def e6_k_sweep(spark, sf):
    return _sweep(spark, sf)


@query("e7_elbow_k")
def e7_elbow_k(spark, sf):
    return K.elbow_k(_sweep(spark, sf))


@query("e8_best_k")
def e8_best_k(spark, sf):
    return K.best_k_by_silhouette(_sweep(spark, sf))


@query("e9_bisecting")
def e9_bisecting(spark, sf):
    return K.bisecting(D.emb_features(spark, sf), FEATS, 10, 42).select("vec_id", "cluster")


@query("e10_merge_table")
def e10_merge_table(spark, sf):
    _, mt, cut = K.micro_cluster_hierarchy(D.emb_features(spark, sf), "vec_id", FEATS, 10,
                                           "ward", 40, 42)
    return mt.withColumn("cut_height_k10", F.lit(cut))


@query("e13_projection_2d")
def e13_projection_2d(spark, sf):
    x, cols = K.cluster_input(D.customer_rfm(spark, sf), RFM, keep=["c_custkey"])
    out, ratios = K.projection_2d(x, cols, keep=["c_custkey"])
    return out.withColumn("ev_ratio_1", F.lit(ratios[0])).withColumn("ev_ratio_2", F.lit(ratios[1]))


@query("e17_method_comparison")
def e17_method_comparison(spark, sf):
    e = D.emb_features(spark, sf)
    a, _, _ = K.kmeans(e, FEATS, 10, n_init=1, seed=42)
    h, _, _ = K.micro_cluster_hierarchy(e, "vec_id", FEATS, 10, "ward", 40, 42)
    s1 = K.silhouette_sq_full(a, FEATS).first()["silhouette_sq"]
    s2 = K.silhouette_sq_full(h, FEATS).first()["silhouette_sq"]
    return K.method_comparison(float(s1), float(s2), spark)


# --- E7/E8 on a sweep table that Spark derives from lineitem (no fit) --------------------

def _line_sweep(spark, sf):
    li = read_table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_linenumber") + 1).cast("int").alias("k")).agg(
        F.sum("l_quantity").alias("wcss"), F.avg("l_discount").alias("silhouette"))


_LINE_SWEEP_SQL = """s AS (SELECT CAST(l_linenumber + 1 AS INTEGER) AS k, sum(l_quantity) AS wcss,
  avg(l_discount) AS silhouette FROM lineitem GROUP BY 1)"""


@query("e7_elbow_of_lines", f"""WITH {_LINE_SWEEP_SQL},
m AS (SELECT min(k) AS k0, max(k) AS k1, min(wcss) AS w0, max(wcss) AS w1, count(*) AS n FROM s),
p AS (SELECT k, n, k0, k1, CAST(k - k0 AS DOUBLE) / (k1 - k0) AS x,
             (wcss - w0) / CASE WHEN w1 = w0 THEN 1 ELSE w1 - w0 END AS y FROM s, m),
c AS (SELECT max(CASE WHEN k = k0 THEN y END) AS yf, max(CASE WHEN k = k1 THEN y END) AS yl FROM p)
SELECT CASE WHEN min(n) < 3 THEN min(k) ELSE arg_min(k, (round(-d, 12), k)) END AS elbow_k
FROM (SELECT p.*, abs((yf - y) + x * (yl - yf)) / sqrt(1 + (yl - yf) * (yl - yf)) AS d FROM p, c) q""")
def e7_elbow_of_lines(spark, sf):
    return K.elbow_k(_line_sweep(spark, sf))


@query("e8_best_k_of_lines", f"""WITH {_LINE_SWEEP_SQL}
SELECT k AS best_k, round(silhouette, 4) AS silhouette FROM s WHERE silhouette IS NOT NULL
ORDER BY s.silhouette DESC, k LIMIT 1""")
def e8_best_k_of_lines(spark, sf):
    return K.best_k_by_silhouette(_line_sweep(spark, sf))
