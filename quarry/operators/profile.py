"""Schema/role inference and column profiling.

Plan shape: every statistic over the whole table is computed by at most two
jobs – one wide aggregate (counts, moments, min/max, parse ratios; partial
aggregation on the map side, a single-row final) and one unpivot + group-by
for exact distinct counts (hash-partitioned on (variable, value)). Results are
long tables with one row per column, small enough to broadcast or collect.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.ranking import running_sums
from quarry.functions.stats import kurt_g2, number, quoted, rnd, skew_g1
from quarry.session import cut_lineage

# Fixed values that must equal the reference's rules.
MAX_CATEGORICAL_UNIQUE = 50
MAX_CATEGORICAL_RATIO = 0.10
ID_LIKE_MIN_ROWS = 100
NUMERIC_STRING_SHARE = 0.8
DATE_RATIO = 0.7
DATE_RATIO_HINTED = 0.3
DATE_NAME_HINTS = ["date", "fecha", "time", "tiempo", "year", "año", "mes",
                   "month", "day", "dia", "timestamp", "created", "updated"]
TARGET_MAX_CLASSES = 20

# Date notations beside ISO: day first, and named months; (shape, Spark pattern).
DATE_SHAPES = [
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"), (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"), (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})?$", "d/M/yyyy H:mm[:ss]"),
]
QUARTILES = [0.25, 0.5, 0.75]

_NUM = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
        T.DoubleType, T.DecimalType, T.BooleanType)
_INT = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_DT = (T.DateType, T.TimestampType, T.TimestampNTZType)


def dtype_of(df: DataFrame, c: str) -> T.DataType:
    return df.schema[c].dataType


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, _NUM)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, _NUM) and not isinstance(f.dataType, T.BooleanType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def _date_ok(c: Column) -> Column:
    # a separator is required: Spark reads a bare "1995" as a timestamp
    # and day-first or named-month dates as pandas would
    return (c.rlike("[-/:]") & c.try_cast("timestamp").isNotNull()) | F.coalesce(
        *(F.when(c.rlike(shape), F.try_to_timestamp(c, F.lit(fmt))) for shape, fmt in DATE_SHAPES)).isNotNull()


def _num_ok(c: Column) -> Column:
    return number(c).isNotNull()


def _stack(row_structs: list[Column]) -> Column:
    return F.inline(F.array(*row_structs))


# --- A3 / A4 -----------------------------------------------------------------

def strip_column_names(df: DataFrame) -> DataFrame:
    """A3: strip whitespace from column names."""
    return df.toDF(*[c.strip() for c in df.columns])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    """A4: drop rows whose every value is NULL (or NaN)."""
    there = [quoted(f.name).isNotNull() & (~F.isnan(quoted(f.name)) if f.dataType.typeName() in ("float", "double") else F.lit(True))
             for f in df.schema.fields]
    return df.where(F.array_contains(F.array(*there), True)) if there else df


# --- B1 numeric-string conversion ---------------------------------------------

def numeric_string_shares(df: DataFrame) -> DataFrame:
    """Per string column: share of ALL rows (NULLs count) that parse as numbers."""
    cols = string_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame(
            [], "column_name string, parse_share double, converted boolean")
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count(number(quoted(c))).alias(f"_p{i}")
                    for i, c in enumerate(cols)])
    long = wide.select(_stack([
        F.struct(F.lit(c).alias("column_name"),
                 F.try_divide(F.col(f"_p{i}"), F.col("_n")).alias("parse_share"))
        for i, c in enumerate(cols)]))
    return long.withColumn("converted",
                           F.coalesce(F.col("parse_share") > NUMERIC_STRING_SHARE, F.lit(False)))


def convert_numeric_strings(df: DataFrame) -> DataFrame:
    """B1: string columns with > 80 % parsing rows become double (others NULL)."""
    shares = numeric_string_shares(df)
    conv = [r["column_name"] for r in shares.where("converted").select("column_name").collect()]
    if not conv:
        return df
    return df.withColumns({c: number(quoted(c)) for c in conv})


# --- B2-B6, B11 column roles ----------------------------------------------------

def profile_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: dtype, counts, exact distinct count, parse ratios, role.

    Columns: position, column, dtype, n_rows, n_valid, n_null, null_pct,
    n_unique, date_ratio, all_numeric, role.
    """
    cols = list(cols or df.columns)
    spark = df.sparkSession
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        col = quoted(c)
        aggs.append(F.count(col).alias(f"_v{i}"))
        if isinstance(dtype_of(df, c), T.StringType):
            aggs.append(F.count(F.when(_date_ok(col), 1)).alias(f"_d{i}"))
            aggs.append(F.count(F.when(_num_ok(col), 1)).alias(f"_u{i}"))
    wide = df.agg(*aggs, *_estimates(df, cols))
    facts = wide.first()  # the estimates say how distinct values are counted
    wide = spark.createDataFrame([facts], wide.schema)
    rows = []
    for i, c in enumerate(cols):
        dt = dtype_of(df, c)
        is_str = isinstance(dt, T.StringType)
        rows.append(F.struct(
            F.lit(i).alias("position"), F.lit(c).alias("column_name"),
            F.lit(dt.simpleString()).alias("dtype"),
            F.col("_n").alias("n_rows"), F.col(f"_v{i}").alias("n_valid"),
            (F.col(f"_d{i}") if is_str else F.lit(None).cast("bigint")).alias("n_date"),
            (F.col(f"_u{i}") if is_str else F.lit(None).cast("bigint")).alias("n_numstr"),
            F.lit(is_numeric_type(dt)).alias("is_num"),
            F.lit(isinstance(dt, _INT)).alias("is_int"),
            F.lit(isinstance(dt, _DT)).alias("is_dt"),
            F.lit(is_str).alias("is_str"),
            F.lit(any(h in c.lower() for h in DATE_NAME_HINTS)).alias("name_hint"),
        ))
    long = wide.select(_stack(rows))
    uniq = distinct_counts(df, cols, facts)
    p = long.join(F.broadcast(uniq), "column_name", "left").fillna(0, ["n_unique"])
    date_ratio = F.when(F.col("is_str") & (F.col("n_valid") > 0),
                        F.col("n_date") / F.col("n_valid"))
    is_datetime = F.col("is_dt") | (F.col("is_str") & (
        (date_ratio > DATE_RATIO) | (F.col("name_hint") & (date_ratio > DATE_RATIO_HINTED))))
    ratio = F.col("n_unique") / F.col("n_valid")
    role = (F.when(F.col("n_valid") == 0, "empty")
             .when(F.coalesce(is_datetime, F.lit(False)), "datetime")
             .when(F.col("is_num") & F.col("is_int") & (F.col("n_unique") == F.col("n_valid"))
                   & (F.col("n_valid") > ID_LIKE_MIN_ROWS), "id_like")
             .when(F.col("is_num"), "numeric")
             .when((F.col("n_unique") <= MAX_CATEGORICAL_UNIQUE)
                   | (ratio <= MAX_CATEGORICAL_RATIO), "categorical")
             .when(F.col("n_numstr") == F.col("n_valid"), "numeric")
             .otherwise("text"))
    return p.select(
        "position", "column_name", "dtype", "n_rows", "n_valid",
        (F.col("n_rows") - F.col("n_valid")).alias("n_null"),
        F.round(F.when(F.col("n_rows") > 0,
                       (F.col("n_rows") - F.col("n_valid")) * 100.0 / F.col("n_rows")), 2)
         .alias("null_pct"),
        "n_unique", rnd(date_ratio).alias("date_ratio"),
        (F.col("n_numstr") == F.col("n_valid")).alias("all_numeric"),
        role.alias("role"))


#: A column of more distinct values than this (estimated) is not deduplicated before
#: its exchange; after it, a task holds at most about so many values.
FEW_DISTINCT = 100_000
VALUES_A_TASK = 500_000


def _estimates(df: DataFrame, cols: Sequence[str]) -> list[Column]:
    """Sketches (a few hundred bytes each) of the distinct values, and exact counts."""
    def plain(c):
        return quoted(c) if isinstance(dtype_of(df, c), T.AtomicType) else quoted(c).cast("string")
    return [a for i, c in enumerate(cols) for a in (F.approx_count_distinct(plain(c)).alias(f"_e{i}"),
                                                    F.count(quoted(c)).alias(f"_c{i}"))]


def distinct_counts(df: DataFrame, cols: Sequence[str], facts=None) -> DataFrame:
    """Exact non-null distinct count per column: (column, n_unique).

    Unpivot to (column, md5(value)) and count distinct pairs, instead of one Expand
    per ``count(distinct)``. md5 keeps shuffle rows small for long text values. Columns
    of few values are deduplicated before the exchange. For the others that would
    only hold a task's every value in memory: they are exchanged as they are, into as
    many tasks as they have ``VALUES_A_TASK``. ``facts``: a row of ``_estimates``.
    """
    cols = list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "column_name string, n_unique bigint")
    if facts is None:
        facts = df.agg(*_estimates(df, cols)).first()
    many = [i for i in range(len(cols)) if facts[f"_e{i}"] > FEW_DISTINCT]

    def pairs(of):
        return df.select(F.explode(F.array(*[
            F.struct(F.lit(i).alias("i"), F.unhex(F.md5(quoted(cols[i]).cast("string"))).alias("h")) for i in of])).alias("p")
        ).select("p.i", "p.h").where(F.col("h").isNotNull())

    few = [i for i in range(len(cols)) if i not in many]
    sets = [pairs(few).distinct()] if few else []
    if many:
        tasks = -(-sum(facts[f"_c{i}"] for i in many) // VALUES_A_TASK)
        sets.append(pairs(many).repartition(tasks, "i", "h").distinct())
    names = F.array(*map(F.lit, cols))
    return reduce(DataFrame.unionByName, (s.groupBy("i").agg(F.count(F.lit(1)).alias("n_unique")) for s in sets)) \
        .select(F.get(names, "i").alias("column_name"), "n_unique")


@dataclass(frozen=True)
class TableProfile:
    """Collected profile (one entry per column) used to build later plans."""

    n_rows: int
    roles: dict[str, str]
    n_unique: dict[str, int]
    null_pct: dict[str, float]
    dtypes: dict[str, str]
    order: list[str] = field(default_factory=list)

    def cols(self, role: str) -> list[str]:
        return [c for c in self.order if self.roles[c] == role]

    @property
    def ml_usable(self) -> list[str]:
        return [c for c in self.order if self.roles[c] in ("numeric", "categorical")]


def collect_profile(df: DataFrame) -> TableProfile:
    """Run the profile job once and keep the (bounded) per-column facts."""
    rows = profile_columns(df).orderBy("position").collect()
    return TableProfile(
        n_rows=rows[0]["n_rows"] if rows else 0,
        roles={r["column_name"]: r["role"] for r in rows},
        n_unique={r["column_name"]: r["n_unique"] for r in rows},
        null_pct={r["column_name"]: r["null_pct"] for r in rows},
        dtypes={r["column_name"]: r["dtype"] for r in rows},
        order=[r["column_name"] for r in rows])


def column_roles(df: DataFrame) -> DataFrame:
    """B3 with B5/B6 flags: role, candidate target, ML-usable."""
    p = profile_columns(df)
    cand = (((F.col("role") == "categorical") & (F.col("n_unique") >= 2)
             & (F.col("n_unique") <= TARGET_MAX_CLASSES))
            | ((F.col("role") == "numeric") & (F.col("n_unique") <= TARGET_MAX_CLASSES)))
    return p.select("column_name", "dtype", "n_valid", "n_unique", "date_ratio", "role",
                    cand.alias("candidate_target"),
                    (F.col("n_unique") >= 2).alias("has_two_values"),
                    F.col("role").isin("numeric", "categorical").alias("ml_usable"))


def column_catalogue(df: DataFrame) -> DataFrame:
    """Name, role, dtype, nulls, null %, distinct."""
    return profile_columns(df).select("position", "column_name", "role", "dtype",
                                      "n_null", "null_pct", "n_unique")


# --- B4, B7, B13, B15 --------------------------------------------------------

def null_profile(df: DataFrame) -> DataFrame:
    """Per column null count, null % (2 dp), has_nulls."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"),
                  *[F.count(F.when(quoted(c).isNull(), 1)).alias(f"_z{i}")
                    for i, c in enumerate(df.columns)])
    return wide.select(_stack([
        F.struct(F.lit(c).alias("column_name"), F.col(f"_z{i}").alias("n_null"),
                 F.round(F.when(F.col("_n") > 0, F.col(f"_z{i}") * 100.0 / F.col("_n")), 2)
                  .alias("null_pct"),
                 (F.col(f"_z{i}") > 0).alias("has_nulls"))
        for i, c in enumerate(df.columns)]))


def null_ranking(df: DataFrame) -> DataFrame:
    """Columns with nulls, most first, with the suggested action tier."""
    p = null_profile(df).where(F.col("n_null") > 0)
    action = (F.when(F.col("null_pct") > 50, "drop_column")
               .when(F.col("null_pct") > 20, "impute_median_mode_or_model")
               .otherwise("impute_simple"))
    return p.select("column_name", "n_null", "null_pct", action.alias("action"),
                    F.dense_rank().over(Window.orderBy(F.desc("n_null"), "column_name"))
                    .alias("rank"))


def dataset_shape(df: DataFrame, prof: DataFrame | None = None) -> DataFrame:
    """B7 + B13: rows, columns, role counts, null cells, completeness %."""
    p = prof if prof is not None else profile_columns(df)
    return p.agg(
        F.max("n_rows").alias("n_rows"),
        F.count(F.lit(1)).alias("n_cols"),
        F.count(F.when(F.col("role") == "numeric", 1)).alias("n_numeric"),
        F.count(F.when(F.col("role") == "categorical", 1)).alias("n_categorical"),
        F.count(F.when(F.col("role") == "datetime", 1)).alias("n_datetime"),
        F.count(F.when(F.col("role") == "text", 1)).alias("n_text"),
        F.count(F.when(F.col("role") == "id_like", 1)).alias("n_id_like"),
        F.sum("n_null").alias("n_null_cells"),
    ).select("*", F.round(F.when(F.col("n_rows") * F.col("n_cols") > 0,
                                 (1 - F.col("n_null_cells") / (F.col("n_rows") * F.col("n_cols")))
                                 * 100), 1).alias("completeness_pct"))


# --- B12 duplicates -------------------------------------------------------------

def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows minus distinct rows (NULLs equal), as a one-row table.

    Rows are grouped by an md5 of their JSON form (timestamps to the microsecond),
    so the shuffle moves 16 bytes per row even when rows hold long texts.
    """
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    h = F.md5(F.to_json(F.struct(*[quoted(c) for c in df.columns]), exact))
    g = df.groupBy(h.alias("_h")).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(F.coalesce(F.sum("_c"), F.lit(0)).cast("bigint").alias("n_rows"),
                 F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).cast("bigint").alias("n_duplicates"))


# --- quantiles ------------------------------------------------------------------

def quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
              method: str = "bracket", pre: dict | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles: (variable, q array in probs order).

    One route at every size, ``bracket``: a sketch brackets each target rank,
    one scan counts the rows below each bracket, and a running count over the
    few candidates inside finds the exact order statistics
    (``bracket_quantiles``); memory bounded for any cardinality and no shuffle
    of the data. ``rank`` (value counts and bucketed running counts over all
    values) is what a column falls back to when a sketch misses; ``map`` (Spark's
    ``percentile``) serves as a check on small data. ``pre`` holds the counts
    and sketch values of ``bracket_aggs`` when an earlier pass computed them.
    """
    cols = list(cols)
    if not cols:
        return df.sparkSession.createDataFrame([], "variable string, q array<double>")
    if method == "bracket":
        return bracket_quantiles(df, cols, probs, pre)
    if method == "map":
        wide = df.agg(*[F.percentile(quoted(c).cast("double"), list(probs)).alias(f"_q{i}")
                        for i, c in enumerate(cols)])
        return wide.select(_stack([F.struct(F.lit(c).alias("variable"),
                                            F.col(f"_q{i}").alias("q"))
                                   for i, c in enumerate(cols)]))
    return _rank_quantiles(df, cols, probs)


# Sketch accuracy of the brackets (rank error <= n / accuracy) and their
# half-width in probability units: a bracket spans about 2 * 4 / accuracy of
# the rows, so ~0.08 % of a column's values are ever ranked exactly.
BRACKET_ACCURACY = 10_000
BRACKET_HALF_WIDTH = 4.0 / BRACKET_ACCURACY


def _widened(probs: Sequence[float]) -> list[float]:
    out = []
    for p in probs:
        out += [max(0.0, p - BRACKET_HALF_WIDTH), min(1.0, p + BRACKET_HALF_WIDTH)]
    return out


def bracket_aggs(cols: Sequence[str], probs: Sequence[float]) -> list[Column]:
    """Aggregates that a moments pass can carry for ``bracket_quantiles``:
    ``_bn{i}`` = non-null count, ``_bk{i}`` = sketch values around each
    target (one sketch per column, bounded by the accuracy)."""
    out = []
    for i, c in enumerate(cols):
        x = quoted(c).cast("double")
        out += [F.count(x).alias(f"_bn{i}"),
                F.percentile_approx(x, _widened(probs), BRACKET_ACCURACY).alias(f"_bk{i}")]
    return out


def bracket_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float],
                      pre: dict | None = None) -> DataFrame:
    """Exact quantiles with three bounded jobs and no shuffle of the data.

    1. (or ``pre``) per column: non-null count n and a percentile sketch
       giving a bracket [a, b] around the rows of 0-based rank floor/ceil of
       p*(n-1) for every target p.
    2. One aggregate scan counts the rows below and inside every bracket
       (one row). The wanted ranks must fall inside the bracket; a column
       failing the check (the sketch missed) uses the rank method instead.
    3. One scan keeps only rows inside some bracket (a filter next to the
       scan) and counts them per (column, target, value). A running count
       over those candidates picks the exact order statistics, interpolated
       like Spark ``percentile`` / pandas ``quantile``. The running count is
       bucketed (``running_sums``).
    """
    spark = df.sparkSession
    cols, probs = list(cols), [float(p) for p in probs]
    if pre is None:
        r = df.agg(*bracket_aggs(cols, probs)).first()
        pre = {c: (r[f"_bn{i}"], r[f"_bk{i}"]) for i, c in enumerate(cols)}
    live = [c for c in cols if pre[c][0]]
    empty = [c for c in cols if not pre[c][0]]
    out = None
    if live:
        below, inside = {}, {}
        for i, c in enumerate(live):
            x = quoted(c).cast("double")
            bk = pre[c][1]
            for j, p in enumerate(probs):
                a, b = bk[2 * j], bk[2 * j + 1]
                below[i, j] = (x < F.lit(a)) if p - BRACKET_HALF_WIDTH > 0 else F.lit(False)
                inside[i, j] = ((x >= F.lit(a)) if p - BRACKET_HALF_WIDTH > 0 else x.isNotNull()) \
                    & ((x <= F.lit(b)) if p + BRACKET_HALF_WIDTH < 1 else F.lit(True))
        keys = list(below)
        # one codegen'd scan: rows below / inside each bracket (one row)
        sz = df.agg(*[e for n, k in enumerate(keys) for e in (
            F.count(F.when(below[k], 1)).alias(f"_b{n}"),
            F.count(F.when(inside[k], 1)).alias(f"_i{n}"))]).first()
        targets, bad = [], set()
        for n, (i, j) in enumerate(keys):
            c = live[i]
            pos = probs[j] * (pre[c][0] - 1)
            lo, hi = math.floor(pos), math.ceil(pos)
            nb, ni = sz[f"_b{n}"], sz[f"_i{n}"]
            if not (nb <= lo and hi < nb + ni):
                bad.add(c)
            targets.append((i, j, lo - nb, hi - nb, float(pos - lo)))
        good = [i for i, c in enumerate(live) if c not in bad]
        if good:
            gk = [k for k in keys if k[0] in good]
            # only rows inside some bracket survive the filter (~0.1 % per
            # target); they are unpivoted to (column, target, value) counts
            hit_any = F.lit(False)
            for k in gk:
                hit_any = hit_any | inside[k]
            cand = (df.where(hit_any)
                    .select(F.inline(F.array(*[F.when(inside[k], F.struct(
                        F.lit(k[0]).alias("v"), F.lit(k[1]).alias("j"),
                        quoted(live[k[0]]).cast("double").alias("x"))) for k in gk])))
                    .where(F.col("v").isNotNull())
                    .groupBy("v", "j", "x").agg(F.count(F.lit(1)).alias("cnt")))
            # columns x targets rows: a bounded broadcast
            tgt = spark.createDataFrame(
                [t for t in targets if t[0] in good],
                "v int, j int, rlo long, rhi long, frac double")
            inb = (running_sums(cand, ["v", "j"], "x", ["cnt"], inclusive_ties=False)  # one row a value
                   .withColumnsRenamed({"cum_cnt": "cum", "before_cnt": "before"}))
            inb = inb.join(F.broadcast(tgt), ["v", "j"])
            at = lambda r: (F.col("before") <= F.col(r)) & (F.col(r) < F.col("cum"))
            pick = inb.where(at("rlo") | at("rhi")).groupBy("v", "j").agg(
                F.max(F.when(at("rlo"), F.col("x"))).alias("vlo"),
                F.max(F.when(at("rhi"), F.col("x"))).alias("vhi"),
                F.first("frac").alias("frac"))
            names = F.element_at(F.array(*[F.lit(c) for c in live]), F.col("v") + 1)
            out = pick.groupBy(names.alias("variable")).agg(
                F.transform(F.array_sort(F.collect_list(F.struct(
                    "j", (F.col("vlo") + F.col("frac") * (F.col("vhi") - F.col("vlo")))
                    .alias("qv")))), lambda s: s["qv"]).alias("q"))
        if bad:
            rk = _rank_quantiles(df, [c for c in live if c in bad], probs)
            out = rk if out is None else out.unionByName(rk)
    if empty:
        e = spark.createDataFrame([(c, None) for c in empty], "variable string, q array<double>")
        out = e if out is None else out.unionByName(e)
    return out


def _rank_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> DataFrame:
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), quoted(c).cast("double").alias("x"))
        for c in cols])).alias("p")).select("p.*")
    return rank_quantiles_long(long, probs)


def rank_quantiles_long(long: DataFrame, probs: Sequence[float]) -> DataFrame:
    """Exact quantiles of ``x`` per ``variable`` (any string key: a column
    name or a group value) from rows (variable, x): value counts with
    partial aggregation, then bucketed exact running counts."""
    long = long.where(F.col("x").isNotNull())
    counts = long.groupBy("variable", "x").agg(F.count(F.lit(1)).alias("cnt"))
    cum = running_sums(counts, ["variable"], "x", ["cnt"], inclusive_ties=False)  # one row a value
    n = counts.groupBy("variable").agg(F.sum("cnt").alias("n"))
    targets = n.select("variable", "n", F.explode(F.array(*[
        F.struct(F.lit(j).alias("j"), F.lit(float(p)).alias("p")) for j, p in enumerate(probs)]))
        .alias("t")).select("variable", "t.j", "t.p", "n")
    targets = targets.withColumns({
        "pos": F.col("p") * (F.col("n") - 1)}).withColumns({
        "lo": F.floor("pos"), "hi": F.ceil("pos")})
    ends = targets.select("variable", "j", "pos", F.explode(F.array(
        F.struct(F.lit("lo").alias("end"), F.col("lo").alias("r")),
        F.struct(F.lit("hi").alias("end"), F.col("hi").alias("r")))).alias("e")
    ).select(F.col("variable").alias("tv"), "j", "pos", "e.end", "e.r")
    # targets: variables x probs x 2 rows, a bounded broadcast
    hit = cum.join(F.broadcast(ends), (F.col("variable") == F.col("tv"))
                   & (F.col("before_cnt") <= F.col("r")) & (F.col("r") < F.col("cum_cnt"))
                   ).select("variable", "j", "pos", "end", "r", "x")
    piv = hit.groupBy("variable", "j", "pos").agg(
        F.max(F.when(F.col("end") == "lo", F.col("x"))).alias("vlo"),
        F.max(F.when(F.col("end") == "hi", F.col("x"))).alias("vhi"),
        F.max(F.when(F.col("end") == "lo", F.col("r"))).alias("rlo"))
    q = piv.select("variable", "j", (F.col("vlo") + (F.col("pos") - F.col("rlo"))
                                     * (F.col("vhi") - F.col("vlo"))).alias("qv"))
    return q.groupBy("variable").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("j", "qv"))),
                    lambda s: s["qv"]).alias("q"))


# --- B8, B9, B10 ---------------------------------------------------------------

def _moments(df: DataFrame, cols: Sequence[str], more=lambda x: []) -> tuple[DataFrame, DataFrame, dict]:
    """(doubles, one row per column, sketches) of one pass that also carries the
    quantile sketches. Every type is cast to double first; the one row per
    column never leaves Spark but for the sketches."""
    wide = df.select(*(F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in cols))
    aggs = [F.count(F.lit(1)).alias("_n")]
    for i, c in enumerate(cols):
        x = quoted(c)
        aggs.append(F.struct(F.lit(c).alias("variable"), F.count(x).alias("n_valid"), F.avg(x).alias("mean"),
                             F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
                             *more(x)).alias(f"_s{i}"))
    row = cut_lineage(wide.agg(*aggs, *bracket_aggs(cols, QUARTILES)))
    first = row.select(*(f"_bn{i}" for i in range(len(cols))), *(f"_bk{i}" for i in range(len(cols)))).first()
    pre = {c: (first[f"_bn{i}"], first[f"_bk{i}"]) for i, c in enumerate(cols)}
    long = row.select(F.col("_n").alias("n_total"), F.inline(F.array(*(f"_s{i}" for i in range(len(cols))))))
    return wide, long, pre


_DESCRIBED = ("variable string, count long, mean double, std double, min double, q25 double, q50 double, "
              "q75 double, max double")


def describe(df: DataFrame, cols: Sequence[str] | None = None,
             method: str = "bracket") -> DataFrame:
    """One row per numeric variable – count, mean, std (ddof 1), min,
    q25, q50, q75, max (4 dp). No numeric column: no row."""
    cols = list(cols or numeric_columns(df))
    if not cols:
        return df.sparkSession.createDataFrame([], _DESCRIBED)
    wide, mom, pre = _moments(df, cols)
    q = quantiles(wide, cols, QUARTILES, method, pre)
    return mom.join(F.broadcast(q), "variable").select(
        "variable", F.col("n_valid").alias("count"), rnd(F.col("mean")).alias("mean"), rnd(F.col("std")).alias("std"),
        rnd(F.col("min")).alias("min"), rnd(F.col("q")[0]).alias("q25"),
        rnd(F.col("q")[1]).alias("q50"), rnd(F.col("q")[2]).alias("q75"),
        rnd(F.col("max")).alias("max"))


def numeric_summary(df: DataFrame, cols: Sequence[str] | None = None,
                    method: str = "bracket") -> DataFrame:
    """Per numeric column totals, distinct share and moments incl. G1/G2."""
    cols = list(cols or numeric_columns(df))
    if not cols:
        return df.sparkSession.createDataFrame([], (
            "variable string, n_total long, n_valid long, n_null long, null_pct double, n_unique long, "
            "unique_pct double, mean double, std double, min double, q25 double, median double, q75 double, "
            "max double, skew double, kurt double"))
    wide, mom, pre = _moments(df, cols, lambda x: [skew_g1(x).alias("skew"), kurt_g2(x).alias("kurt")])
    q = quantiles(wide, cols, QUARTILES, method, pre)
    # of the values as they are: doubles do not tell integers above 2^53 apart
    kind = {f.name: f.dataType.typeName() for f in df.schema.fields}
    u = distinct_counts(df.select(*(
        F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double")).alias(c) if kind.get(c) in ("float", "double", "string")
        else quoted(c).alias(c) for c in cols)), cols).withColumnRenamed("column_name", "variable")
    j = mom.join(F.broadcast(q), "variable").join(F.broadcast(u), "variable", "left")
    n_null = F.col("n_total") - F.col("n_valid")
    return j.select(
        "variable", "n_total", "n_valid", n_null.alias("n_null"),
        F.round(F.try_divide(n_null * 100.0, F.col("n_total")), 2).alias("null_pct"),
        F.coalesce("n_unique", F.lit(0)).alias("n_unique"),
        F.round(F.when(F.col("n_valid") > 0, F.coalesce("n_unique", F.lit(0)) * 100.0
                       / F.col("n_valid")).otherwise(0.0), 2).alias("unique_pct"),
        rnd(F.col("mean")).alias("mean"), rnd(F.col("std")).alias("std"),
        rnd(F.col("min")).alias("min"), rnd(F.col("q")[0]).alias("q25"),
        rnd(F.col("q")[1]).alias("median"), rnd(F.col("q")[2]).alias("q75"),
        rnd(F.col("max")).alias("max"), rnd(F.col("skew")).alias("skew"),
        rnd(F.col("kurt")).alias("kurt"))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, value, count) for the given columns, NULLs excluded.

    The group-by is partially aggregated on the map side, so a value holding
    a third of all rows costs one row per task in the shuffle.
    """
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("variable"), quoted(c).cast("string").alias("value"))
        for c in cols])).alias("p")).select("p.*").where(F.col("value").isNotNull())
    return long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("count"))


def top_values(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Top-k values per column by count desc, value asc.

    ``row_number() <= k`` is planned as a WindowGroupLimit: each task keeps
    its own top-k before the exchange.
    """
    vc = value_counts(df, cols)
    w = Window.partitionBy("variable").orderBy(F.desc("count"), F.asc("value"))
    return (vc.withColumn("rank", F.row_number().over(w))
              .where(F.col("rank") <= k))


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mode per column (most frequent, smallest value on ties): (variable, mode).

    min over struct(-count, value) after a partial-aggregated count: no
    value map is ever held in one task.
    """
    vc = value_counts(df, cols)
    return vc.groupBy("variable").agg(
        F.min(F.struct((-F.col("count")).alias("nc"), F.col("value").alias("v")))["v"]
        .alias("mode"))


def categorical_summary(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Top-5 values with counts plus the column mode."""
    return top_values(df, cols, k).join(F.broadcast(modes(df, cols)), "variable")
