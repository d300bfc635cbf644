"""The scale-safe (bucketed / rank) routes must equal brute-force results."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quarry.functions.ranking import md5_bucket, row_rank, running_sums
from quarry.operators import distrib as X
from quarry.operators import metrics as M
from quarry.operators import profile as P


def test_running_sums_equal_window(spark):
    df = spark.range(3000).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 997).alias("x"),
                                  (F.col("id") % 5).alias("w"))
    got = running_sums(df, ["g"], "x", ["w"], n_buckets=7, inclusive_ties=True)
    w = Window.partitionBy("g").orderBy("x").rangeBetween(Window.unboundedPreceding, 0)
    exp = df.withColumn("e", F.sum("w").over(w))
    j = got.join(exp, ["g", "x", "w"]).where(F.col("cum_w") != F.col("e"))
    assert j.count() == 0


def test_descending_running_sums(spark):
    df = spark.range(500).select(F.lit(1).alias("g"), (F.col("id") % 37).cast("double").alias("s"),
                                 F.lit(1).alias("c"))
    got = running_sums(df, ["g"], "s", ["c"], n_buckets=5, descending=True).select("s", "cum_c").distinct()
    exp = {s: sum(1 for i in range(500) if i % 37 >= s) for s in range(37)}
    assert all(exp[int(r["s"])] == r["cum_c"] for r in got.collect())


def test_row_rank_md5_buckets(spark):
    df = spark.range(2000).select(F.md5(F.col("id").cast("string")).alias("h"), (F.col("id") % 2).alias("g"))
    got = row_rank(df, ["g"], "h", bucket=md5_bucket(F.col("h")))
    exp = df.withColumn("e", F.row_number().over(Window.partitionBy("g").orderBy("h")) - 1)
    assert got.join(exp, ["g", "h"]).where(F.col("rank0") != F.col("e")).count() == 0


def test_box_stats_equal_percentile(spark):
    df = spark.range(5000).select((F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 1.37 % 101).alias("x"))
    exp = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("x", [0.25, 0.5, 0.75]).alias("q")).collect()}
    for r in X.box_stats(df, "x", "g").collect():
        assert [r["q1"], r["median"], r["q3"]] == [round(v, 4) for v in exp[r["group"]]]


def test_macro_roc_bucket_invariance(spark):
    rows = [(float(i % 3), (i * 37 % 101) / 100.0, (i * 53 % 89) / 88.0) for i in range(600)]
    df = spark.createDataFrame(rows, "label double, a double, b double").select(
        "label", F.col("a").alias("p0"), F.col("b").alias("p1"), (1 - F.col("a")).alias("p2"))
    c1, a1 = M.macro_roc(df, "label", ["p0", "p1", "p2"], [0.0, 1.0, 2.0], n_buckets=1)
    c2, a2 = M.macro_roc(df, "label", ["p0", "p1", "p2"], [0.0, 1.0, 2.0], n_buckets=64)
    assert sorted(c1.collect()) == sorted(c2.collect())
    assert a1.first()[0] == pytest.approx(a2.first()[0], abs=1e-9)


def test_dictionary_encode_sorted_codes(spark):
    from quarry.operators.prep import dictionary_encode
    vals = [f"Customer#{i:06d}" for i in range(3000)]
    train = spark.createDataFrame([(v,) for v in vals], "c string")
    new = spark.createDataFrame([(vals[5],), (vals[2999],), ("zz",)], "c string")
    got = [r[0] for r in dictionary_encode(new, "c", train, n_buckets=16).orderBy("c").collect()]
    assert sorted(got) == sorted([5.0, 2999.0, -1.0])


def test_linkage_heights():
    import numpy as np
    from quarry.operators.cluster import _linkage
    pts, w = np.array([[0.0], [1.0], [10.0], [12.0]]), np.ones(4)
    last = {m: _linkage(pts, w, m)[-1][2] for m in ("single", "complete", "average", "ward")}
    assert last["single"] == 9.0 and last["complete"] == 12.0 and last["average"] == 10.5
    assert abs(last["ward"] - 14.8492) < 1e-4


def test_bracket_quantiles_equal_percentile(spark):
    # a hot value holding a third of the rows, a spread column and NULLs
    df = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.col("id") * 0.731 % 509).alias("hot"),
        ((F.col("id") * 7919) % 6007).cast("double").alias("spread"),
        F.when(F.col("id") % 4 == 0, None).otherwise(F.col("id") / 9.0).alias("nulls"))
    probs = [0.0, 0.001, 0.25, 0.5, 0.333, 0.75, 0.999, 1.0]
    exp = {r["variable"]: r["q"] for r in P.quantiles(df, df.columns, probs, "map").collect()}
    got = {r["variable"]: r["q"] for r in P.quantiles(df, df.columns, probs).collect()}
    assert set(got) == set(exp)
    for c in exp:
        assert got[c] == pytest.approx(exp[c], abs=1e-9)


def test_distinct_counts_of_many_values(spark, monkeypatch):
    monkeypatch.setattr(P, "FEW_DISTINCT", 50)
    monkeypatch.setattr(P, "VALUES_A_TASK", 300)
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("few"), F.when(F.col("id") % 2 == 0, F.col("id") % 700).alias("x"),
                                  F.lit(None).cast("string").alias("none"))
    d = P.distinct_counts(df, df.columns)
    assert {r[0]: r[1] for r in d.collect()} == {"id": 2000, "few": 3, "x": 350}
    # columns of many values are exchanged by value before any aggregate, into tasks by their number
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and f", {-(-3000 // 300)})" in plan


def test_few_codes_are_joined_without_an_exchange(spark):
    from quarry.operators import prep as C
    df = spark.createDataFrame([(i, float(i % 11), "abc"[i % 3] if i % 7 else None) for i in range(200)], "k long, x double, t string")
    m = C.fit_prep(df, C.PrepSpec(target="t", exclude=("k",), encoder="label"))
    out = m.transform(df, keep=["k"])
    assert sorted((r["k"], r["label"]) for r in out.collect()) == [(i, float(i % 3)) for i in range(200) if i % 7]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in m.transform(df, keep=["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
