"""CSV files read in small blocks, against Python's csv module."""

import csv
import io
import random

import pytest

from quarry.sources import csv as IO


@pytest.fixture
def small_blocks(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    old = {n: spark.conf.get(n, None) for n in names}
    spark.conf.set(names[0], "700b")
    spark.conf.set(names[1], "1b")
    yield
    for n, v in old.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def table(rng, n):
    odd = ["", "x", 'say "hi"', "two\nlines", "a,b", '"', '""', "\n", "é\n日本\n", 'end"\n"begin', "\r\ncarriage", ",\n,", " y ", "z" * 300,
           "\n".join(["a long field"] * 60)]
    return [[str(i), *(rng.choice(odd) for _ in range(3))] for i in range(n)]


def theirs(text):
    return [r for r in csv.reader(io.StringIO(text, newline="")) if r][1:]


def ours(spark, path):
    rows = IO.read_csv(spark, str(path), infer_schema=False).collect()
    return sorted([[v or "" for v in r] for r in rows])


@pytest.mark.parametrize("quoting, ends", [(csv.QUOTE_MINIMAL, "\n"), (csv.QUOTE_ALL, "\r\n"), (csv.QUOTE_NONNUMERIC, "\n")])
def test_quoted_line_breaks_over_blocks(spark, small_blocks, tmp_path, quoting, ends):
    out = io.StringIO(newline="")
    writer = csv.writer(out, quoting=quoting, lineterminator=ends)
    writer.writerow(["id", "a", "b\nbroken", "c"])
    writer.writerows(table(random.Random(ends), 250))
    path = tmp_path / "t.csv"
    path.write_bytes(out.getvalue().encode())
    assert spark.read.text(str(path)).rdd.getNumPartitions() > 20
    df = IO.read_csv(spark, str(path), infer_schema=False)
    assert df.columns == ["id", "a", "b\nbroken", "c"]
    assert ours(spark, path) == sorted(theirs(out.getvalue()))


def test_quotes_within_plain_fields(spark, small_blocks, tmp_path):
    text = 'id,size,note\n' + "".join(f'{i},{i}" pipe,"a ""q"" {i}\nsecond"\n' if i % 3 else f'{i},5" and "6,plain\n' for i in range(200))
    path = tmp_path / "t.csv"
    path.write_text(text)
    assert ours(spark, path) == sorted(theirs(text))


def test_each_file_has_its_own_encoding(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "a.csv").write_bytes("n,t\n1,café\n".encode("latin-1"))
    (folder / "b.csv").write_bytes("n,t\n2,naïve 日本\n".encode())
    (folder / "c.csv").write_bytes("n,t\n3,caf\ufffd é\n".encode())
    (folder / "d.csv").write_bytes("\ufeffn,t\n4,mark\n".encode())
    assert ours(spark, folder) == [["1", "café"], ["2", "naïve 日本"], ["3", "caf\ufffd é"], ["4", "mark"]]


def test_whole_numbers_keep_their_digits(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,big,mixed,none\n1234567890123456789,12345678901234567890,1.5,\n1234567890123456790,1,12345678901234567890,\n")
    df = IO.load_file(spark, str(path))
    assert dict(df.dtypes) == {"id": "bigint", "big": "string", "mixed": "string", "none": df.schema["none"].dataType.simpleString()}
    assert sorted(r.id for r in df.collect()) == [1234567890123456789, 1234567890123456790]
    assert {r.big for r in df.collect()} == {"12345678901234567890", "1"}


def test_names_blank_lines_short_rows_and_errors(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,a,,b.c\n1,2,3,4\n\n   \n5,6\n7,8,9,10,11\n")
    df = IO.load_file(spark, str(path))
    assert df.columns == ["a", "a.1", "_c2", "b.c"]
    assert sorted([tuple(r) for r in df.collect()]) == [(1, 2, 3, 4), (5, 6, None, None), (7, 8, 9, 10)]
    path.write_text('a,b\n1,"never closed\n2,x\n')
    with pytest.raises(IO.LoadError):
        IO.load_file(spark, str(path))
    path.write_text("")
    with pytest.raises(IO.LoadError):
        IO.load_file(spark, str(path))


def _written(tmp_path, **files):
    for name, text in files.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode() if isinstance(text, str) else text)
    return str(tmp_path)


def test_plain_lines_need_no_python_and_are_parsed_once(spark, tmp_path):
    from quarry.sources import csv as IO
    at = _written(tmp_path, a="k,v\r\n1,x\r\n\r\n2,\r\n", b="k,v\r\n3,k\r\n")
    d = IO.drop_empty_rows(IO.read_csv(spark, at))
    assert d.dtypes == [("k", "bigint"), ("v", "string")]
    assert sorted(map(tuple, d.collect())) == [(1, "x"), (2, None), (3, "k")]
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("from_csv") == 1


def test_header_line_as_data_and_other_headers(spark, tmp_path):
    from quarry.sources import csv as IO
    for i, files in enumerate((dict(a="k,v\n1,x\nk,v\n"), dict(a="k,v\n1,x\n", b="x,y\nk,v\n"),
                               dict(a="k,v\n1,x\n", b='k,v\nk,"v"\n'), dict(a="k,v\n1,x\n", b=b"k,v\nk,\xf1\n"))):
        (tmp_path / str(i)).mkdir()
        got = sorted(map(tuple, IO.read_csv(spark, _written(tmp_path / str(i), **files)).collect()))
        assert got == [("1", "x"), ("k", "ñ" if i == 3 else "v")]


def test_types_of_columns(spark, tmp_path):
    from quarry.sources import csv as IO
    at = _written(tmp_path, a="a,b,c,d,e,f,g\n1,1,true,2020-01-02,99999999999999999999,,-2020\n 2,.5,FALSE,2021/03/04,1,NA,2020-01-01\n")
    kinds = dict(IO.read_csv(spark, at).dtypes)
    assert [kinds[c] for c in "abcef"] == ["bigint", "double", "boolean", "string", "string"]
