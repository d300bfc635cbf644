"""Streaming sources read a table however it lies there."""

import pytest

from quarry.sources.tables import read_table, stream_table


@pytest.mark.parametrize("parts", ["file", "folder", "partitioned"])
def test_stream_table_reads_every_row(spark, tmp_path, parts):
    rows = [(i, f"t{i}", "en" if i % 2 else "es", "web", 2) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    at = tmp_path / "documents.parquet"
    if parts == "file":
        df.coalesce(1).write.parquet(str(tmp_path / "made"))
        at.write_bytes(next((tmp_path / "made").glob("*.parquet")).read_bytes())
    else:
        (df.write.partitionBy("lang") if parts == "partitioned" else df.repartition(3).write).parquet(str(at))
    s = stream_table(spark, str(tmp_path), "documents")
    assert s.isStreaming and s.schema == read_table(spark, str(tmp_path), "documents").schema
    s.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text", "lang", "source", "n_chars")
    assert sorted(map(tuple, got.collect())) == rows


def test_scored_documents_of_part_files(spark, tmp_path):
    from quarry.plans.q_checks import g16_scored_documents
    docs = [(i, "word " * (1 + i % 7) + "end\n" * (i % 3), "en" if i % 2 else "es", f"s{i % 3}", 10 + i % 50)
            for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long") \
        .repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 120, 3)], "doc_id long, quality int, toxic int") \
        .write.parquet(str(tmp_path / "labels.parquet"))
    got = g16_scored_documents(spark, str(tmp_path)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(120))
    assert all(r["sums_to_one"] and r["is_argmax"] for r in got)


def _documents(spark, at, labels, source=lambda i: f"s{i % 3}"):
    docs = [(i, "word " * (1 + i % 7) + "end\n" * (i % 3), "en" if i % 2 else "es", source(i), 10 + i % 50)
            for i in range(120)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long") \
        .repartition(3).write.parquet(str(at / "documents.parquet"))
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int") \
        .write.parquet(str(at / "labels.parquet"))
    return str(at)


@pytest.mark.parametrize("parts", ["file", "folder"])
def test_stream_table_takes_colons_in_names(spark, tmp_path, parts):
    at = tmp_path / "run 10:30"
    sf = _documents(spark, at, [(1, 0)])
    (at / "notes: old.txt").write_text("beside the tables")
    if parts == "file":
        spark.read.parquet(f"{sf}/documents.parquet").coalesce(1).write.parquet(str(tmp_path / "made"))
        sf = str(tmp_path / "one 10:30")
        (tmp_path / "one 10:30").mkdir()
        (tmp_path / "one 10:30" / "documents.parquet").write_bytes(
            next((tmp_path / "made").glob("*.parquet")).read_bytes())
    stream_table(spark, sf, "documents").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 120


@pytest.mark.parametrize("labels,source", [
    # the one row of class 2 is a test row: no tree knows the class
    ([(i, i % 2) for i in range(0, 120, 3)] + [(1, 2)], lambda i: f"s{i % 3}"),
    # 12 classes: p10 and p11 come after p9
    ([(i, i % 12) for i in range(120)], lambda i: f"s{i % 3}"),
    # sources are numbers where there are labels, words elsewhere
    ([(i, i % 2) for i in range(60)], lambda i: "7" if i < 60 else "web"),
    # names that are no plain column names
    ([(i, i % 2) for i in range(0, 120, 3)], lambda i: ("a.example.org", "it`s", "Web", "web")[i % 4]),
], ids=["class_not_in_training", "twelve_classes", "words_for_numbers", "odd_names"])
def test_scored_documents_of_odd_tables(spark, tmp_path, labels, source):
    from quarry.plans.q_checks import g16_scored_documents
    got = g16_scored_documents(spark, _documents(spark, tmp_path, labels, source)).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(120))
    assert all(r["sums_to_one"] and r["is_argmax"] for r in got)


def test_predict_and_votes_with_odd_names(spark):
    from quarry.operators import classify as CL
    rows = [(i, float(i % 2), float(i % 4 == 1), float(i % 4 == 3)) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, label double, `s_a.b` double, `s_A.b` double")
    names = ["s_a.b", "s_A.b"]
    model = CL.fit(CL.decision_tree(max_depth=3), df, names)
    got = CL.predict(model, df, names, 3, keep=["doc_id"]).collect()
    assert all(r["prediction"] == r["label"] and r["p2"] == 0.0 for r in got)
    assert CL.oob_votes(df, "doc_id", names, n_trees=2, max_depth=3).count() == 80


def test_score_stream_of_no_rows(spark, tmp_path):
    from quarry.plans.flagship import trained
    from quarry.streaming.scoring import score_stream
    sf = _documents(spark, tmp_path, [(i, i % 2) for i in range(0, 120, 3)])
    _, m, model = trained(spark, sf)
    (tmp_path / "none").mkdir()
    source = spark.readStream.schema("doc_id long, n_chars double, words double, lines double, lang string, "
                                     "source string").parquet(str(tmp_path / "none"))
    got = score_stream(spark, source, m, model, keep=["doc_id"])
    assert got.columns == ["doc_id", "prediction", "p0", "p1"] and got.count() == 0


def test_doc_quality_exchanges_no_texts(spark, tmp_path):
    from quarry.plans.derived import doc_quality
    plan = doc_quality(spark, _documents(spark, tmp_path, [(1, 0)]))._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    assert "text" not in plan.output().toString()
