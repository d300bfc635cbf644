"""Ordinary input that clean tables do not hold: quotes, late bad bytes, constants, decimals, odd names."""

import csv
import datetime
import glob
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quarry.operators import cluster as E
from quarry.operators import distrib as X
from quarry.operators import metrics as M
from quarry.operators import prep as C
from quarry.operators import profile as P
from quarry.operators import split as S
from quarry.sources import csv as IO
from quarry.sources import sinks as SK


def test_latin1_byte_on_the_last_line(spark, tmp_path):
    path = tmp_path / "late.csv"
    path.write_bytes(b"a,b\n" + b"plain,1\n" * 50000 + "café,2\n".encode("latin-1"))
    df = IO.load_file(spark, str(path))
    assert df.where("a = 'café'").count() == 1 and df.count() == 50001


def test_csv_quotes_line_breaks_and_missing_values(spark, tmp_path):
    rows = [("say \"hi\"", "two\nlines", 1), ("a, b", " padded ", 2), ("x", None, 3), ("y", "NA", 4)]
    path = SK.write_csv(spark.createDataFrame(rows, "a string, b string, n int"), str(tmp_path / "out.csv"))
    found = sorted(map(tuple, IO.load_file(spark, path).collect()), key=lambda r: r[2])
    assert found == [("say \"hi\"", "two\nlines", 1), ("a, b", " padded ", 2), ("x", None, 3), ("y", None, 4)]
    theirs = [r for f in glob.glob(f"{path}/*.csv") for r in list(csv.reader(open(f, newline="")))[1:]]
    assert sorted(theirs, key=lambda r: r[2])[:2] == [["say \"hi\"", "two\nlines", "1"], ["a, b", " padded ", "2"]]
    path = tmp_path / "types.csv"
    path.write_text("i,f,t,s\n1,1.5,true,1d\nNA,n/a,false,x\n3,2,NULL,NaN\n")
    df = IO.load_file(spark, str(path))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "t": "boolean", "s": "string"}
    assert df.where("s is null").count() == 1


def test_numbers_and_dates_in_text(spark):
    df = spark.createDataFrame([("1d", "13/02/2020"), ("2f", "01/12/2021"), ("3L", "5/6/2020")], "n string, d string")
    assert not P.numeric_string_shares(df).where("converted").count()
    assert df.where(P._date_ok(F.col("d"))).count() == 3
    named = spark.createDataFrame([("Jan 5, 2020",), ("5 Feb 2021",), ("nothing",)], "d string")
    assert named.where(P._date_ok(F.col("d"))).count() == 2


def test_constant_columns_and_many_columns_correlate(spark):
    df = spark.range(50).select(F.lit(3.3).alias("c"), F.col("id").cast("double").alias("x"),
                                (F.col("id") * -2.5 + 1e6).alias("y"), F.when(F.col("id") < 9, 0.1).alias("p"))
    r = {(x.var_a, x.var_b): x.r for x in X.corr_pairs(df, ["c", "x", "y", "p"]).collect()}
    assert r["c", "x"] is None and r["x", "p"] is None and r["x", "y"] == pytest.approx(-1)
    wide = spark.range(300).select(*[(F.xxhash64("id", F.lit(k)) % 1000).cast("double").alias(f"v{k}") for k in range(120)])
    found = {(x.var_a, x.var_b): x.r for x in X.corr_pairs(wide, wide.columns).collect()}
    assert len(found) == 120 * 119 // 2
    assert found["v3", "v77"] == pytest.approx(wide.select(F.corr("v3", "v77")).first()[0])


def test_curves_without_a_class(spark):
    df = spark.createDataFrame([(1.0, 0.2), (1.0, 0.7)], "label double, s double")
    assert M.binary_roc(df, "label", "s").count() == 0
    assert M.binary_auc(df, "label", "s").first()["auc"] is None
    assert M.classification_metrics(df.withColumn("prediction", F.lit(1.0)), score_cols=["s"]).first()["auc"] == 0.5
    three = spark.createDataFrame([(0.0, 0.9, 0.1, 0.0), (1.0, 0.3, 0.7, 0.0)], "label double, p0 double, p1 double, p2 double")
    curve, auc = M.macro_roc(three, "label", ["p0", "p1", "p2"], [0.0, 1.0, 2.0])
    assert auc.count() == 1


def test_types_and_names(spark):
    df = spark.createDataFrame([(Decimal("1.10"), float("nan"), "a"), (Decimal("3.30"), 2.0, "b"), (None, 4.0, "b")],
                               "`price.usd` decimal(10,2), f double, s string")
    rows = {r.variable: r for r in P.describe(df).collect()}
    assert rows["price.usd"].mean == 2.2 and rows["f"].mean == 3.0 and rows["f"].max == 4.0
    assert {r.variable for r in P.numeric_summary(df).collect()} == {"price.usd", "f"}
    assert P.describe(df.select("s")).count() == 0 and P.numeric_summary(df.select("s")).count() == 0
    empty = P.describe(df.limit(0)).collect()
    assert [r["count"] for r in empty] == [0, 0]
    assert P.numeric_string_shares(df.limit(0)).first()["parse_share"] is None
    t = datetime.datetime(2020, 1, 1)
    times = spark.createDataFrame([(t,), (t + datetime.timedelta(microseconds=1),), (t,)], "t timestamp")
    assert P.duplicate_rows(times).first()["n_duplicates"] == 1


def test_many_categories_and_classes(spark):
    df = spark.range(12000).select(F.col("id"), F.concat(F.lit("c"), F.col("id") % 6000).alias("cat"),
                                   (F.col("id") % 2000).cast("string").alias("target"))
    cuts = S.stratified_split(df, "id", "target")
    assert cuts.count() == 12000 and cuts.groupBy("target").agg(F.count_if(F.col("split") == "test").alias("n")) \
        .where("n != 1").isEmpty()
    codes = C.dictionary_encode(df.select("cat"), "cat", df)
    assert codes.agg(F.max("cat")).first()[0] == 5999.0
    assert M.confusion_counts(df.select(F.col("target").cast("double").alias("label"),
                                        F.col("target").cast("double").alias("prediction"))).count() == 2000


def test_splits_move_no_payload(spark):
    rows = spark.range(500).select("id", (F.col("id") % 3).alias("label"), F.repeat(F.lit("x"), 50).alias("payload"))
    for split in (S.stratified_split(rows, "id", "label"), S.shuffled_split(rows, "id"), S.stratified_folds(rows, "id", "label")):
        plan = split._jdf.queryExecution().executedPlan().toString()
        assert not any("Exchange hashpartitioning" in line and "payload" in line for line in plan.split("\n"))
        assert split.count() == 500
    sizes = dict(S.shuffled_split(rows, "id").groupBy("split").count().collect())
    assert sizes == {"test": 75, "val": 75, "train": 350}
    folds = S.stratified_folds(rows, "id", "label", 5).groupBy("label", "fold").count()
    assert folds.agg(F.max("count") - F.min("count")).first()[0] <= 1


def test_points_on_top_of_each_other(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (2, 0, 5.0), (3, 1, 5.0), (4, 1, 5.0)], "id int, cluster int, x double")
    assert E.silhouette(df, "id", ["x"]).first()["silhouette"] == 0.0
    sweep = spark.createDataFrame([(4, 10.0, 0.5)], "k int, wcss double, silhouette double")
    assert E.elbow_k(sweep).first()["elbow_k"] == 4
    with pytest.raises(ValueError):
        E.micro_cluster_hierarchy(df, "id", ["x"], 2, m=1000)
