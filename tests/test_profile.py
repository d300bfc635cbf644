import math

import pytest
from pyspark.sql import functions as F

from quarry.operators import distrib as X
from quarry.operators import profile as P


def test_stats5_summary(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4, 10)], "x double")
    r = P.numeric_summary(df, ["x"]).first()
    assert r["mean"] == 4.0 and r["std"] == pytest.approx(3.5355, abs=1e-4)
    assert (r["q25"], r["median"], r["q75"]) == (2.0, 3.0, 4.0)
    assert r["skew"] == pytest.approx(1.6971, abs=1e-4)
    assert r["kurt"] == pytest.approx(3.1520, abs=1e-4)
    o = X.iqr_outliers(df, ["x"]).first()
    assert (o["lower"], o["upper"], o["n_outliers"]) == (-1.0, 7.0, 1)


def test_distinct_numbers_above_doubles(spark):
    df = spark.range(50).selectExpr("9007199254740993 + id as a", "cast(id as decimal(38, 0)) + 12345678901234567890 as b",
                                    "if(id < 2, double('nan'), id % 7) as c")
    rows = {r["variable"]: r for r in P.numeric_summary(df, ["a", "b", "c"]).collect()}
    assert [rows[c]["n_unique"] for c in "abc"] == [50, 50, 7] and rows["a"]["unique_pct"] == 100.0


@pytest.mark.parametrize("method", ["map", "rank", "bracket"])
def test_quantile_methods_agree(spark, method):
    df = spark.range(0, 1001).select((F.col("id") * 0.37 % 17).alias("x"))
    exp = df.select(F.percentile("x", [0.1, 0.25, 0.5, 0.9])).first()[0]
    got = P.quantiles(df, ["x"], [0.1, 0.25, 0.5, 0.9], method).first()["q"]
    assert got == pytest.approx(exp, abs=1e-9)


def test_const_column_skipped_in_outliers(spark):
    df = spark.createDataFrame([(3.0,), (3.0,), (3.0,)], "x double")
    assert X.iqr_outliers(df, ["x"]).count() == 0
    r = P.numeric_summary(df, ["x"]).first()
    assert r["skew"] == 0.0 and r["kurt"] is None and r["std"] == 0.0


def test_ties_mode_and_nulls(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "x string")
    assert P.modes(df, ["x"]).first()["mode"] == "a"
    p = P.profile_columns(df).first()
    assert p["n_unique"] == 2 and p["null_pct"] == 20.0


def test_duplicates_nulls_equal(spark):
    df = spark.createDataFrame([(1, "x"), (1, "x"), (None, "y"), (None, "y"), (2, "z")], "a int, b string")
    assert P.duplicate_rows(df).first()["n_duplicates"] == 2


def test_drop_empty_rows(spark):
    df = spark.createDataFrame([(1, "x"), (None, None), (None, "y")], "a int, b string")
    assert P.drop_empty_rows(df).count() == 2


def test_pairwise_complete_corr(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.1), (3.0, None), (4.0, 8.5)], "a double, b double")
    r = X.corr_pairs(df, ["a", "b"]).first()["r"]
    assert r == pytest.approx(0.99994, abs=1e-5)


def test_roles(spark):
    rows = [(i, f"t{i}", ["u", "v"][i % 2], float(i % 7), f"2024-01-{1 + i % 28:02d}") for i in range(150)]
    df = spark.createDataFrame(rows, "id long, txt string, cat string, num double, d string")
    roles = {r["column_name"]: r["role"] for r in P.column_roles(df).collect()}
    assert roles == {"id": "id_like", "txt": "text", "cat": "categorical", "num": "numeric",
                     "d": "datetime"}


def test_numeric_string_conversion(spark):
    rows = [(str(i),) for i in range(9)] + [("n/a",)]
    df = spark.createDataFrame(rows, "s string")
    out = P.convert_numeric_strings(df)
    assert dict(out.dtypes)["s"] == "double"
    rows2 = [(str(i),) for i in range(8)] + [("n/a",), ("x",)]
    assert dict(P.convert_numeric_strings(spark.createDataFrame(rows2, "s string")).dtypes)["s"] == "string"
