"""Tree classifiers, class weights, importances, CV and out-of-bag accuracy
(SURVEY F1-F7, F10-F12).

Training uses Spark ML (distributed histogram-based trees); features enter
as one ``VectorAssembler`` column at the ML boundary. Parameter mapping from
the reference's options is in SURVEY §2.12.
"""

from __future__ import annotations

import math
import os
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import seeded_uniform
from quarry.functions.stats import rnd
from quarry.operators import metrics as M
from quarry.session import FIT_PARALLELISM, checkpoint_dir, cut_lineage

CRITERIA = {"gini": "gini", "entropy": "entropy", "log_loss": "entropy"}
MAX_FEATURES = {"sqrt": "sqrt", "log2": "log2", None: "all", "all": "all"}
OOB_DEFAULT_TREES = 20


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """balanced weights n / (k * n_c) per class (k rows)."""
    g = df.where(F.col(label).isNotNull()).groupBy(F.col(label).alias("class")).agg(
        F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy()  # k rows
    return g.select("class", "n", (F.sum("n").over(w) / (F.count(F.lit(1)).over(w) * F.col("n")))
                    .alias("weight"))


def with_weights(df: DataFrame, label: str) -> DataFrame:
    """Attach the balanced weight as a column (class table inlined)."""
    rows = class_weights(df, label).collect()
    expr = F.lit(1.0)
    for r in rows:
        expr = F.when(F.col(label) == r["class"], F.lit(float(r["weight"]))).otherwise(expr)
    return df.withColumn("weight", expr)


def assemble(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with ``features``. One-hot names hold categories as they are (dots,
    backticks, two that differ in case), so the feature columns are taken by place
    and are named by it in the result."""
    at = {c: f"_x{i}" for i, c in enumerate(features)}
    return VectorAssembler(inputCols=list(at.values()), outputCol="features",
                           handleInvalid="keep").transform(df.toDF(*[at.get(c, c) for c in df.columns]))


def class_scores(n_classes: int) -> list[Column]:
    """p0..p{k-1} of a scored frame. The model knows classes up to the last one among
    its training rows; later ones, of other rows only, have probability 0."""
    arr = vector_to_array("probability")
    return [F.coalesce(F.get(arr, F.lit(i)), F.lit(0.0)).alias(f"p{i}") for i in range(n_classes)]


def _min_instances(min_split: int, min_leaf: int) -> int:
    # no Spark twin of min_samples_split: max(leaf, ceil(split / 2)) guarantees it
    return max(int(min_leaf), int(math.ceil(min_split / 2)))


def decision_tree(max_depth: int = 5, min_split: int = 2, min_leaf: int = 1,
                  criterion: str = "gini", max_features=None, class_weight: str | None = None,
                  seed: int = 42, max_bins: int = 32):
    """a single tree. With a feature subset strategy it becomes a
    one-tree forest without bootstrap (the only Spark way to subsample
    features per split)."""
    common = dict(maxDepth=max_depth, minInstancesPerNode=_min_instances(min_split, min_leaf),
                  impurity=CRITERIA[criterion], maxBins=max_bins, labelCol="label",
                  featuresCol="features", seed=seed)
    if class_weight == "balanced":
        common["weightCol"] = "weight"
    if MAX_FEATURES.get(max_features, "all") != "all":
        return RandomForestClassifier(numTrees=1, bootstrap=False,
                                      featureSubsetStrategy=MAX_FEATURES[max_features], **common)
    return DecisionTreeClassifier(**{k: v for k, v in common.items() if k != "seed"}, seed=seed)


def random_forest(n_trees: int = 100, max_depth: int = 10, min_split: int = 2, min_leaf: int = 1,
                  max_features="sqrt", class_weight: str | None = None, bootstrap: bool = True,
                  criterion: str = "gini", seed: int = 42, max_bins: int = 32):
    """forest; ``balanced_subsample`` maps to ``balanced`` (per-bag
    weights are not exposed by Spark)."""
    kw = dict(numTrees=n_trees, maxDepth=max_depth,
              minInstancesPerNode=_min_instances(min_split, min_leaf),
              featureSubsetStrategy=MAX_FEATURES.get(max_features, "all"), bootstrap=bootstrap,
              impurity=CRITERIA[criterion], maxBins=max_bins, labelCol="label",
              featuresCol="features", seed=seed)
    if class_weight in ("balanced", "balanced_subsample"):
        kw["weightCol"] = "weight"
    return RandomForestClassifier(**kw)


def fit(estimator, train: DataFrame, features: Sequence[str]):
    x = assemble(train, features)
    if estimator.hasParam("weightCol") and estimator.isSet("weightCol"):
        x = with_weights(x, "label")
    return estimator.fit(x)


def predict(model, df: DataFrame, features: Sequence[str], n_classes: int,
            keep: Sequence[str] = ()) -> DataFrame:
    """Rows with label, prediction and p0..p{k-1} class probabilities."""
    out = model.transform(assemble(df, features))
    return out.select(*keep, "label", "prediction", *class_scores(n_classes))


def feature_importance(model, names: Sequence[str], top: int = 20) -> DataFrame:
    """importances ranked, top 20, flagged when >= the median (of all)."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    imp = model.featureImportances.toArray()
    rows = [(n, float(v)) for n, v in zip(names, imp)]
    d = spark.createDataFrame(rows, "feature string, importance double")
    med = float(sorted(imp)[len(imp) // 2] if len(imp) % 2 else
                (sorted(imp)[len(imp) // 2 - 1] + sorted(imp)[len(imp) // 2]) / 2)
    w = Window.orderBy(F.desc("importance"), "feature")  # one row per feature
    return (d.select("feature", rnd(F.col("importance")).alias("importance"),
                     F.row_number().over(w).alias("rank"),
                     (F.col("importance") >= med).alias("above_median"))
            .where(F.col("rank") <= top))


def tree_nodes(model, names: Sequence[str], max_depth: int = 5) -> DataFrame:
    """nodes (id, depth, feature, threshold, gain, impurity, prediction)
    down to ``max_depth``, read back from the model's saved node table in
    the shared checkpoint folder."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = os.path.join(checkpoint_dir(spark), f"tree-{model.uid}")
    model.write().overwrite().save(path)
    nodes = spark.read.parquet(os.path.join(path, "data"))
    if "treeID" in nodes.columns:
        nodes = nodes.where(F.col("treeID") == 0).select("nodeData.*")
    names_arr = F.array(*[F.lit(n) for n in names])
    # depth: a node's children carry the ids; depth by iterating parent links
    # on the (small) node table of one tree
    n = nodes.select("id", "prediction", "impurity", "gain", "leftChild", "rightChild",
                     F.col("split.featureIndex").alias("fi"),
                     F.col("split.leftCategoriesOrThreshold").alias("thr"))
    rows = {r["id"]: r for r in n.collect()}  # one tree: bounded by 2^(maxDepth+1)
    depth, stack = {}, [(0, 0)]
    while stack:
        i, dpt = stack.pop()
        if i not in rows or i in depth:
            continue
        depth[i] = dpt
        r = rows[i]
        for ch in (r["leftChild"], r["rightChild"]):
            if ch is not None and ch >= 0:
                stack.append((ch, dpt + 1))
    out = [(int(i), int(d), names[rows[i]["fi"]] if rows[i]["leftChild"] >= 0 else None,
            float(rows[i]["thr"][0]) if rows[i]["leftChild"] >= 0 and rows[i]["thr"] else None,
            float(rows[i]["gain"]), float(rows[i]["impurity"]), float(rows[i]["prediction"]))
           for i, d in depth.items() if d <= max_depth]
    del names_arr
    return spark.createDataFrame(out, "id int, depth int, feature string, threshold double, "
                                      "gain double, impurity double, prediction double")


def cross_validate(estimator_fn, df: DataFrame, features: Sequence[str], folds_col: str = "fold",
                   k: int = 5, metric: str = "f1", classes: Sequence[float] | None = None) -> DataFrame:
    """fit per fold on the other folds, score the held-out fold with F8;
    mean and population std of the chosen metric (default weighted F1)."""
    base = cut_lineage(df)

    def fold_score(f):
        m = fit(estimator_fn(), base.where(F.col(folds_col) != f), features)
        p = m.transform(assemble(base.where(F.col(folds_col) == f), features))
        r = M.classification_metrics(p, "label", "prediction", classes=classes).first()
        return float(r[metric])

    # the folds are independent fits: concurrent Spark jobs over the
    # checkpointed rows (as CrossValidator(parallelism=...) runs them)
    with ThreadPoolExecutor(max_workers=min(k, FIT_PARALLELISM)) as ex:
        vals = list(ex.map(fold_score, range(k)))
    mean = sum(vals) / len(vals)
    std = math.sqrt(sum((v - mean) ** 2 for v in vals) / len(vals))
    spark = df.sparkSession
    return spark.createDataFrame([(round(mean, 4), round(std, 4), len(vals))],
                                 "cv_mean double, cv_std double, n_folds int")


def _poisson1(u):
    # inverse CDF of Poisson(1) on u in [0,1): weights 0..5
    cdf, acc, fact = [], 0.0, 1.0
    for j in range(6):
        fact = fact * j if j > 0 else 1.0
        acc += math.exp(-1.0) / fact
        cdf.append(acc)
    w = F.lit(6)
    for j in reversed(range(6)):
        w = F.when(u < F.lit(cdf[j]), F.lit(j)).otherwise(w)
    return w.cast("double")


def oob_votes(df: DataFrame, key: str, features: Sequence[str], n_trees: int = OOB_DEFAULT_TREES,
              max_depth: int = 10, seed: int = 42, max_features="sqrt") -> DataFrame:
    """(key, label, votes): for each row the class votes of the trees that did
    not see it. Tree t draws a Poisson(1) weight per row from md5(seed|key|t)
    (reproducible, no row movement); a row's weights are one array column. Trees
    are trained on the rows of weight above 0, concurrently; then one scan passes
    the rows through all of them, and each row keeps the votes of its 0 weights."""
    weights = F.array(*(_poisson1(seeded_uniform(seed, F.col(key), F.lit(t))) for t in range(n_trees)))
    base = cut_lineage(assemble(df, features).select(key, "label", weights.alias("weights"), "features"))

    def tree(t):
        est = decision_tree(max_depth=max_depth, max_features=max_features, seed=seed + t)
        est.setWeightCol("weight")
        m = est.fit(base.select("label", "features", F.col("weights")[t].alias("weight")).where("weight > 0"))
        return m.setPredictionCol(f"_p{t}").setProbabilityCol("").setRawPredictionCol("")

    with ThreadPoolExecutor(max_workers=FIT_PARALLELISM) as ex:
        trees = list(ex.map(tree, range(n_trees)))
    out = base
    for m in trees:
        out = m.transform(out)
    votes = F.array_compact(F.array(*(F.when(F.col("weights")[t] == 0, F.col(f"_p{t}")) for t in range(n_trees))))
    return out.select(key, "label", votes.alias("votes"))


def oob_accuracy(df: DataFrame, key: str, features: Sequence[str], n_trees: int = OOB_DEFAULT_TREES,
                 max_depth: int = 10, seed: int = 42, max_features="sqrt") -> DataFrame:
    """out-of-bag accuracy of our own bagging: the majority of each row's
    ``oob_votes`` (the smaller class on ties) against its label; rows that every
    tree saw do not count."""
    v = oob_votes(df, key, features, n_trees, max_depth, seed, max_features).where(F.size("votes") > 0)
    counts = F.transform(F.array_distinct("votes"), lambda c: F.struct(
        (-F.size(F.filter("votes", lambda x: x == c))).alias("k"), c.alias("p")))
    top = v.select("label", F.array_min(counts)["p"].alias("vote"))
    return top.agg(rnd(F.avg((F.col("vote") == F.col("label")).cast("double"))).alias("oob_accuracy"),
                   F.count(F.lit(1)).alias("n_oob_rows"))
