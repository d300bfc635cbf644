import __spark_entry__ as entry


def test_registry_consistent():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 100


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and set(df.columns) >= {"accuracy", "f1", "auc"}


def test_some_queries_on_smoke_data(spark):
    q = entry.queries()
    for name in ("b10_describe_lineitem", "d1_stratified_split", "f8_metrics_multiclass",
                 "c17_pipeline_transform", "e4_inertia_fixed"):
        assert q[name](spark, "/root/testdata/sf0.001").count() >= 1
