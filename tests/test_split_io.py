import os
import tempfile

import pytest
from pyspark.sql import functions as F

from quarry.operators import split as S
from quarry.sources import csv as IO


def test_stratified_split_sizes_and_determinism(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(1000)]
    df = spark.createDataFrame(rows, "k long, y string")
    a = S.stratified_split(df, "k", "y")
    b = S.stratified_split(df.repartition(7), "k", "y")
    assert sorted(a.collect()) == sorted(b.collect())
    sizes = {r["split"]: r["count"] for r in a.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 1000 and 680 <= sizes["train"] <= 720


def test_ordered_split_is_ordered(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    out = S.ordered_split(df, "k")
    mx = {r["split"]: (r["lo"], r["hi"]) for r in out.groupBy("split").agg(
        F.min("k").alias("lo"), F.max("k").alias("hi")).collect()}
    assert mx["train"][1] < mx["val"][0] and mx["val"][1] < mx["test"][0]


def test_csv_semicolon(spark):
    d = tempfile.mkdtemp(prefix="quarry-test-")
    p = os.path.join(d, "t.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write('a;b;c\n1;"x,y";2.5\n2;"p,q";3.5\n3;z;4.5\n')
    assert IO.sniff_delimiter(spark, p) == ";"
    df = IO.load_file(spark, p)
    assert df.columns == ["a", "b", "c"] and df.count() == 3


def test_csv_latin1(spark):
    d = tempfile.mkdtemp(prefix="quarry-test-")
    p = os.path.join(d, "t.csv")
    with open(p, "wb") as f:
        f.write("a,b\nañ,2\n".encode("latin-1"))
    v = IO.load_file(spark, p).first()["a"]
    assert v == "añ" and "�" not in v


def test_load_errors(spark):
    with pytest.raises(IO.LoadError):
        IO.load_file(spark, "/tmp/x.xlsx")
