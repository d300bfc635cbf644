import pytest
from pyspark.sql import functions as F

from quarry.operators import cluster as K
from quarry.operators import prep as C


def test_sil4(spark):
    df = spark.createDataFrame([(1, 0.0, 0), (2, 1.0, 0), (3, 10.0, 1), (4, 12.0, 1)],
                               "k long, x double, cluster int")
    rows = {r["k"]: r["s"] for r in K.silhouette_rows(df, "k", ["x"]).collect()}
    assert [rows[i] for i in (1, 2, 3, 4)] == pytest.approx([0.9091, 0.9, 0.7895, 0.8261], abs=1e-4)
    assert K.silhouette(df, "k", ["x"]).first()[0] == pytest.approx(0.8562, abs=1e-4)


def test_elbow5(spark):
    sw = spark.createDataFrame([(2, 100.0, None), (3, 40.0, None), (4, 30.0, None), (5, 25.0, None),
                                (6, 22.0, None)], "k int, wcss double, silhouette double")
    assert K.elbow_k(sw).first()["elbow_k"] == 3


def test_encode_unknown(spark):
    train = spark.createDataFrame([("a",), ("b",), ("c",)], "x string")
    new = spark.createDataFrame([("b",), ("zz",)], "x string")
    for enc in ("onehot", "label"):
        m = C.fit_prep(train, C.PrepSpec(encoder=enc))
        got = [tuple(r) for r in m.transform(new).collect()]
        if enc == "onehot":
            assert got == [(0.0, 1.0, 0.0), (0.0, 0.0, 0.0)]
        else:
            assert got == [(1.0,), (-1.0,)]
    m = C.fit_prep(train, C.PrepSpec(encoder="ordinal"))
    with pytest.raises(Exception):
        m.transform(new).collect()


def test_constant_scaling(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (3.0,)], "x double")
    for sc in ("standard", "minmax", "robust"):
        m = C.fit_prep(df, C.PrepSpec(scaler=sc))
        assert [r[0] for r in m.transform(df).collect()] == [0.0, 0.0, 0.0]


def test_kmeans_wcss_non_increasing(spark):
    rows = [(i, float(i % 10), float((i * 7) % 13)) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    sw = K.k_sweep(df, ["a", "b"], 5, "k")
    w = [r["wcss"] for r in sw.orderBy("k").collect()]
    assert all(x >= y - 1e-6 for x, y in zip(w, w[1:]))


def test_sweep_and_comparison_take_no_sample(spark, monkeypatch):
    def no(*a, **b):
        raise AssertionError("sampled")
    monkeypatch.setattr(K, "sample_rows", no)
    df = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 3 * 10 + F.col("id") / 1000).alias("a"))
    rows = {r["k"]: r["silhouette"] for r in K.k_sweep(df, ["a"], 3, "k").collect()}
    assert rows[3] > rows[2] > 0
    one = df.select("a", F.lit(0).alias("cluster"))
    assert K.silhouette_sq_full(one, ["a"]).first()[0] == 0.0 and K.silhouette_sq_full(one.limit(0), ["a"]).first()[0] is None
    from quarry.plans import q_cluster
    assert q_cluster.e17_method_comparison(spark, "/root/testdata/sf0.001").count() == 2


def test_k_sweep_keeps_one_vector_frame(spark, monkeypatch):
    df = spark.range(60).select(F.col("id").alias("k"), (F.col("id") % 3 * 10 + F.col("id") / 100).alias("a"))
    made, real = [], K._vectors
    monkeypatch.setattr(K, "_vectors", lambda *a: made.append(real(*a)) or made[-1])
    sw = K.k_sweep(df, ["a"], 4, "k").collect()
    assert [r["k"] for r in sw] == [2, 3, 4] and len(made) == 1
    assert not made[0].storageLevel.useMemory and not made[0].storageLevel.useDisk
    for r in sw:
        a, _, _ = K.kmeans(df, ["a"], r["k"], n_init=1, seed=42)
        assert abs(a.agg(F.sum("sq_dist")).first()[0] - r["wcss"]) < 1e-6
        assert abs(K.silhouette_sq_full(a, ["a"]).first()[0] - r["silhouette"]) < 1e-6
