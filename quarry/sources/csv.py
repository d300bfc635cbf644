"""CSV/Parquet loading with delimiter sniffing and encoding fallback (A1-A5).

A CSV file is read by as many tasks as it has blocks, also if fields hold line
breaks: each block is summed up as what becomes of either quoting state, the
states at the borders follow from the blocks before, and only the lines of records
with line breaks are brought together.
"""

from __future__ import annotations

import csv
import io
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.stats import nan_to_null, number, quoted
from quarry.operators.profile import drop_empty_rows, strip_column_names

# Fixed values that must equal the reference's loader.
DELIMITERS = [",", ";", "\t", "|", ":"]
SUPPORTED = (".csv", ".parquet")
# What pandas reads as missing.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


class LoadError(ValueError):
    """A5: unsupported extension or empty table."""


def _header_fields(line: str, sep: str) -> int:
    """Field count of a header line, honouring double quotes."""
    n, quoted = 1, False
    for ch in line:
        if ch == '"':
            quoted = not quoted
        elif ch == sep and not quoted:
            n += 1
    return n


def _delimiter(line: str) -> str:
    return max(DELIMITERS, key=lambda d: _header_fields(line, d))  # the first of equals


def sniff_delimiter(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """A1: the delimiter giving the most header columns (first wins ties)."""
    head = (spark.read.option("encoding", encoding).text(path).limit(1).collect())
    if not head:
        raise LoadError("empty file")
    return _delimiter(head[0][0] or "")


# --- A1, A2: records of quoted lines, encoding of each file --------------------------------

class _Lines:
    """Whether a line ends within a quoted field, if it begins outside or inside
    one. A quote opens a field only at its beginning; two quotes in a quoted field
    are one; what follows a closing quote belongs to the field."""

    def __init__(self, sep: str):
        rest = f"[^{re.escape(sep)}]*+"
        quoted, sep = r'[^"]*+(?:""[^"]*+)*+', re.escape(sep)
        fields = f'(?:(?:"{quoted}"{rest}|(?!"){rest}){sep})*+'
        self.open = re.compile(f'{fields}"{quoted}'.encode())
        self.inside = re.compile(f'{quoted}(?:"{rest}{sep}{fields}"{quoted})?'.encode())

    def ends(self, line: bytes) -> tuple[bool, bool]:
        return self.open.fullmatch(line) is not None, self.inside.fullmatch(line) is not None


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, pos, value): the lines as bytes. A task reads blocks of files,
    each in order; a block is (file, its offset)."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("pos"), F.col("value").cast("binary").alias("value"))


def _by_block(batches):
    """(file, block, rows of it) in the order in which they come."""
    for batch in batches:
        if not len(batch):
            continue
        block = batch.column(1).to_numpy()
        file = batch.column(0).dictionary_encode()
        codes = (file.dictionary if hasattr(file, "dictionary") else file.chunk(0).dictionary, file.indices.to_numpy())
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (codes[1][1:] != codes[1][:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(block)]):
            yield codes[0][int(codes[1][a])].as_py(), int(block[a]), batch.slice(a, b - a)


def _quoted_lines(values) -> np.ndarray:
    return np.flatnonzero(pc.match_substring(values, '"').to_numpy(zero_copy_only=False))


def _valid(values) -> bool:
    try:
        values.cast(pa.string())
        return True
    except pa.ArrowInvalid:
        return False


_ENDS = "file string, block long, ends0 boolean, ends1 boolean, opens0 long, opens1 long, valid boolean"


def _block_ends(sep: str):
    """For each block: from either state at its begin, the state at its end and the
    number of lines that open a record of several lines; and whether it is UTF-8."""
    def run(batches):
        lines, last, state, opens, valid = _Lines(sep), None, None, None, None

        def done():
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, *state, *opens, valid)],
                                              [c.split()[0] for c in _ENDS.split(", ")])

        for file, block, rows in _by_block(batches):
            if (file, block) != last:
                if last:
                    yield done()
                last, state, opens, valid = (file, block), [False, True], [0, 0], True
            values = rows.column(3)
            valid = valid and _valid(values)
            for i in _quoted_lines(values).tolist():
                ends = lines.ends(values[i].as_py())
                for j in (0, 1):
                    opens[j] += ends[state[j]] and not state[j]
                    state[j] = ends[state[j]]
        if last:
            yield done()
    return run


class Layout:
    """What a task must know of the blocks before its own: one entry a block (128 MB
    of text by default), and the files that are not UTF-8."""

    def __init__(self, blocks: list):
        self.latin1 = {r["file"] for r in blocks if not r["valid"]}
        #: (file, block) -> whether it begins within a record, and that record's name (block, number)
        self.begins: dict[tuple[str, int], tuple[bool, tuple[int, int] | None]] = {}
        self.unclosed, state, name, of = [], False, None, None
        self.several = any(r["opens0"] or r["opens1"] for r in blocks)
        for r in sorted(blocks, key=lambda r: (r["file"], r["block"])):
            if r["file"] != of:
                self.unclosed += [of] if state else []
                state, name, of = False, None, r["file"]
            self.begins[of, r["block"]] = (state, name)
            opens = r[f"opens{int(state)}"]
            name = (r["block"], opens) if opens else name
            state = r[f"ends{int(state)}"]
        self.unclosed += [of] if state else []


_RECORDS = "file string, at long, seq long, pos long, head boolean, latin1 boolean, value binary"


def _records(sep: str, layout):
    """Lines with the name (at, seq) of the record of several lines they belong to;
    null for records of one line. ``head`` marks the first line of a file."""
    def run(batches):
        lines, last, state, name, seq = _Lines(sep), None, False, None, 0
        for file, block, rows in _by_block(batches):
            values, n = rows.column(3), len(rows)
            head = np.zeros(n, dtype=bool)
            if (file, block) != last:
                last, seq, head[0] = (file, block), 0, block == 0
                state, name = layout.value.begins[file, block]
            names, inside, begin = np.zeros((2, n), dtype=np.int64), np.zeros(n, dtype=bool), 0
            for i in _quoted_lines(values).tolist():
                after = lines.ends(values[i].as_py())[state]
                if state and not after:
                    inside[begin:i + 1], names[:, begin:i + 1] = True, np.array(name)[:, None]
                elif after and not state:
                    begin, seq = i, seq + 1
                    name = (block, seq)
                state = after
            if state:
                inside[begin:], names[:, begin:] = True, np.array(name)[:, None]
            at, number = (pa.array(x, mask=~inside) for x in names)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), at, number, rows.column(2), pa.array(head),
                 pa.array(np.full(n, file in layout.value.latin1)), values], [c.split()[0] for c in _RECORDS.split(", ")])
    return run


def read_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """(file, head, record): the records of all files, each file decoded by its own
    bytes (UTF-8, or Latin-1 if any of its lines is no valid UTF-8). Blocks are read
    by as many tasks as the scan has. The first pass learns how each block ends, the
    second one names the lines of records that have several; only those are
    exchanged. A quote that is never closed would make the rest of its file one
    record: that is a LoadError."""
    lines = _lines(spark, path)
    layout = Layout(lines.mapInArrow(_block_ends(sep), _ENDS).collect())  # a row a block
    if layout.unclosed:
        raise LoadError(f"a quote is never closed in {layout.unclosed[0]}")
    rows = lines.mapInArrow(_records(sep, spark.sparkContext.broadcast(layout)), _RECORDS)
    text = F.when(F.col("latin1"), F.decode("value", "ISO-8859-1")).otherwise(F.col("value").cast("string"))
    rows = rows.select("file", "at", "seq", "pos", "head", text.alias("record"))
    one = rows.where("at is null").select("file", "head", "record")
    if not layout.several:  # no line opens one
        return one
    several = rows.where("at is not null").groupBy("file", "at", "seq").agg(
        F.max("head").alias("head"), F.array_sort(F.collect_list(F.struct("pos", "record"))).alias("l")) \
        .select("file", "head", F.concat_ws("\n", F.transform("l", lambda x: x["record"])).alias("record"))
    return one.unionByName(several)


def _one_line_records(spark: SparkSession, path: str, header: str) -> DataFrame | None:
    """The records below the header if each line is one: no line holds a quote, all
    are UTF-8, and every file begins with ``header`` and has no such line again in its
    first block, so that the header is known by its value. None if not. One aggregate
    without Python; the records are then the lines as Spark reads them."""
    text = spark.read.option("lineSep", "\n").text(path)
    first_block = F.col("_metadata.file_block_start") == 0
    is_head, pos = first_block & (F.col("value") == header), F.monotonically_increasing_id()
    files = text.select(F.when(first_block, F.col("_metadata.file_path")).alias("file"), is_head.alias("head"), pos.alias("pos"),
                        (F.is_valid_utf8("value") & ~F.contains("value", F.lit('"'))).alias("plain")).groupBy("file").agg(
        F.bool_and("plain").alias("plain"), F.count(F.when(F.col("head"), 1)).alias("heads"),
        F.min("pos").alias("first"), F.min(F.when(F.col("head"), F.col("pos"))).alias("head"))
    same = F.col("file").isNull() | ((F.col("heads") == 1) & (F.col("head") == F.col("first")))
    if not files.agg(F.bool_and(F.col("plain") & F.coalesce(same, F.lit(False)))).first()[0]:
        return None
    return text.where(~is_head).select(F.col("value").alias("record"))


def typed(df: DataFrame) -> DataFrame:
    """Columns of strings as what all their values are: whole numbers, numbers,
    booleans, timestamps or text; NA tokens are NULL. One aggregate."""
    df = df.select(*(F.when(~quoted(c).isin(*NA_TOKENS), quoted(c)).alias(c) for c in df.columns))
    tests = ("bigint", "double", "boolean", "timestamp")  # a value's bit i says whether it is a tests[i]

    def bits(c):
        whole = c.rlike(r"^\s*[+-]?\d+\s*$")
        # a whole number beyond 64 bits would lose digits: such a column stays text
        kind = (F.when(whole, F.when(F.trim(c).try_cast("bigint").isNotNull(), 3).otherwise(0))
                .when(number(c).isNotNull(), 2).when(F.lower(c).isin("true", "false"), 4).otherwise(0))
        dated = F.contains(c, F.lit("-")) | F.contains(c, F.lit("/")) | F.contains(c, F.lit(":"))
        return F.when(c.isNotNull(), kind + F.when(dated & c.try_cast("timestamp").isNotNull(), 8).otherwise(0))

    fits = df.agg(*(F.bit_and(bits(quoted(c))).alias(f"_{i}") for i, c in enumerate(df.columns))).first()
    kinds = [next((k for j, k in enumerate(tests) if (fits[i] or 0) >> j & 1), None) for i in range(len(df.columns))]
    return df.select(*(quoted(c) if kind is None else F.trim(quoted(c)).cast(kind).alias(c)
                       for c, kind in zip(df.columns, kinds)))


def read_csv(spark: SparkSession, path: str, infer_schema: bool = True) -> DataFrame:
    """A1+A2: a header and standard quoting (a quote in a field is doubled, fields
    may hold line breaks); the delimiter comes from the first file's header, the
    encoding of each file from its bytes. Blank lines are no records."""
    first = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")).limit(1).collect()
    if not first:
        raise LoadError("empty file")
    sep = _delimiter(bytes(first[0]["value"]).decode("latin-1"))
    head, rows = _decoded(bytes(first[0]["value"])), None
    if head is not None:
        rows = _one_line_records(spark, path, head)
    if rows is None:
        rows = read_records(spark, path, sep)
        head = rows.where("head").orderBy("file").select("record").first()[0]
        rows = rows.where(~F.col("head"))
    head = re.sub("^\ufeff", "", re.sub("\r$", "", head))
    names = _names(next(csv.reader(io.StringIO(head, newline=""), delimiter=sep), []))
    options = {"sep": sep, "quote": '"', "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1", "maxColumns": str(max(20480, len(names)))}
    schema = ", ".join(f"_{i} string" for i in range(len(names)))
    rows = rows.select(F.when(F.contains("record", F.lit("\r")), F.regexp_replace("record", "\r$", "")).otherwise(
        F.col("record")).alias("record")).where(F.trim("record") != "")
    # generated rows are parsed once; later filters on a projected struct would parse them again for each column
    df = rows.select(F.inline(F.array(F.from_csv("record", schema, options)))).toDF(*names)
    return typed(df) if infer_schema else df


def _decoded(line: bytes) -> str | None:
    try:
        return line.decode()
    except UnicodeDecodeError:
        return None


def _names(header: list[str]) -> list[str]:
    """Column names: blank ones by their place, repeated ones with a number."""
    out: list[str] = []
    for i, name in enumerate(header):
        base, n = name if name.strip() else f"_c{i}", 0
        name = base
        while name in out:
            n += 1
            name = f"{base}.{n}"
        out.append(name)
    return out


def load_file(spark: SparkSession, path: str) -> DataFrame:
    """A1-A5: load, strip names, drop all-NULL rows, NaN -> NULL; typed
    errors for unsupported files and empty tables."""
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in SUPPORTED:
        raise LoadError(f"unsupported file type {ext or '(none)'}; use CSV or Parquet")
    df = spark.read.parquet(path) if ext == ".parquet" else read_csv(spark, path)
    df = drop_empty_rows(strip_column_names(df))
    df = nan_to_null(df)
    if df.isEmpty():
        raise LoadError("the table has no rows")
    return df
