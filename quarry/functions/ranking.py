"""Exact ranks and running sums over a sorted key without a global window.

``Window.orderBy(x)`` with no ``partitionBy`` moves every row into one task.
Here the rows are range-partitioned by (groups, order, tie-breaker) and written
once to the shared checkpoint folder, so that the ranges stay what they are. Only
one total per (group, range) is ordered globally: ranges follow one another, so
that is one row a range and one more for each group. A row's running sum is its
group's total in the ranges before plus a window within (group, range).

Range bounds come from Spark's own sampling of the sort key, of any type. Rows with
equal order values are spread over ranges by the tie-breaker, or are added up
first where ties count as one. An order key that is uniform by construction (an
md5) needs no sampling: its prefix is passed as ``bucket``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage


def md5_bucket(md5_col: Column, hex_digits: int = 4) -> Column:
    """Uniform bucket 0..16^d-1 from an md5 hex string; monotone in it.

    4 hex digits = 65 536 buckets: a class of 3e11 rows (a third of a 1e12
    row table) is ranked in windows of ~5e6 rows each."""
    return F.conv(F.substring(md5_col, 1, hex_digits), 16, 10).cast("int")


def ranged(df: DataFrame, order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """``df`` with the number ``_bkt`` of its range by ``order``, written once.
    Ranges are numbered in their order; there are as many as shuffle partitions,
    unless ``ranges`` says otherwise."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *order).withColumn("_bkt", F.spark_partition_id()))


def running_sums(df: DataFrame, groups: Sequence[str], order_col: str,
                 sum_cols: Sequence[str], bucket: Column | None = None,
                 descending: bool = False, n_buckets: int | None = None,
                 inclusive_ties: bool = True,
                 tie_breaker: Sequence[str] = (), next_cols: Sequence[str] = ()) -> DataFrame:
    """Add ``cum_<c>`` = running sum of c ordered by ``order_col`` per group.

    With ``inclusive_ties`` the running sum at a row includes every row with
    an equal order key (a RANGE frame); otherwise it is a ROWS frame ordered
    by (order_col, *tie_breaker). Also adds ``before_<c>`` = cum minus the
    rows at the same key (RANGE) or the current row (ROWS).

    ``next_<c>`` for ``next_cols`` (without ties only) is the value in the group's
    next row, NULL in its last: within a range a ``lead``, at its end the first
    row of the group's next range.
    """
    groups = list(groups)
    if inclusive_ties and bucket is None:
        # ties are one row, however many there are; the join back is left to AQE's skew handling
        keys = [*groups, order_col]
        names = {c: f"_s{i}" for i, c in enumerate(keys)}
        sums = df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sum_cols))
        sums = running_sums(sums, groups, order_col, sum_cols, None, descending, n_buckets, False).drop(*sum_cols)
        sums = sums.withColumnsRenamed(names)
        same = [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]
        return df.join(sums, same).drop(*names.values())
    okey = F.col(order_col).desc() if descending else F.col(order_col).asc()
    if bucket is None:
        df = ranged(df, [*map(F.col, groups), okey, *map(F.col, tie_breaker)], n_buckets)
    else:
        df = df.withColumn("_bkt", -bucket if descending else bucket)
    # totals of (group, bucket) -> exclusive offsets
    own = F.struct(*next_cols) if next_cols else F.lit(None)
    first = F.max_by(own, F.col(order_col)) if descending else F.min_by(own, F.col(order_col))
    tot = df.groupBy(*groups, "_bkt").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols], first.alias("_f"))
    # without groups there is one row a bucket, so a single ordered task is fine
    by_range = (Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))).orderBy("_bkt")
    wo = by_range.rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)), F.col("_bkt").alias("_b"),
                     F.lead("_f").over(by_range).alias("_f"),
                     *[F.coalesce(F.sum(f"_t_{c}").over(wo), F.lit(0)).alias(f"_o_{c}")
                       for c in sum_cols])
    # joined on the window's own partition keys: the big side is exchanged
    # once by (groups, bucket) and the window below reuses that partitioning
    # (AQE turns the join into a broadcast when the offset table is small)
    same = [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(groups)] + [F.col("_bkt") == F.col("_b")]
    df = df.join(off, same).drop("_b", *(f"_g{i}" for i in range(len(groups))))
    wb = Window.partitionBy(*groups, "_bkt")
    if inclusive_ties:
        w = wb.orderBy(okey).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        w = wb.orderBy(okey, *tie_breaker).rowsBetween(Window.unboundedPreceding,
                                                        Window.currentRow)
    cols = {}
    for c in sum_cols:
        cols[f"cum_{c}"] = F.col(f"_o_{c}") + F.sum(c).over(w)
    if next_cols:
        df = df.withColumn("_f", F.coalesce(F.lead(own).over(wb.orderBy(okey, *tie_breaker)), "_f"))
    cols |= {f"next_{c}": F.col("_f")[c] for c in next_cols}
    df = df.withColumns(cols)
    if inclusive_ties:
        wt = Window.partitionBy(*groups, "_bkt", order_col)
        df = df.withColumns({f"before_{c}": F.col(f"cum_{c}") - F.sum(c).over(wt)
                             for c in sum_cols})
    else:
        df = df.withColumns({f"before_{c}": F.col(f"cum_{c}") - F.col(c)
                             for c in sum_cols})
    return df.drop("_bkt", "_f", *[f"_o_{c}" for c in sum_cols])


def row_rank(df: DataFrame, groups: Sequence[str], order_col: str,
             bucket: Column | None = None, tie_breaker: Sequence[str] = ()) -> DataFrame:
    """0-based exact rank within ``groups`` by (order_col, *tie_breaker)."""
    out = running_sums(df.withColumn("_one", F.lit(1)), groups, order_col, ["_one"],
                       bucket=bucket, inclusive_ties=False, tie_breaker=tie_breaker)
    return out.withColumn("rank0", F.col("before__one")).drop("_one", "cum__one",
                                                              "before__one")


def sorted_codes(values: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """(groups, value, code): the place, from 0, of each different non-NULL value
    in the sorted order of its group. A dictionary of any size stays a table."""
    distinct = values.where(F.col(value).isNotNull()).select(*groups, value).distinct()
    return row_rank(distinct, groups, value).select(*groups, value, F.col("rank0").alias("code"))


def keys_at(df: DataFrame, order: Sequence[str], places: Sequence[Column]) -> DataFrame:
    """(j, key, n): the rows' key struct at each of ``places`` (1-based, expressions
    in ``n``, the number of rows) in the order of ``order``; key is NULL for place 0.
    Only the order columns move, once; one range is sorted for each place."""
    rows = ranged(df.select(*order), [F.col(c) for c in order])
    wo = Window.partitionBy(F.lit(0)).orderBy("_bkt")  # one row a range
    ends = rows.groupBy("_bkt").agg(F.count("*").alias("rows")).select(
        "_bkt", F.sum("rows").over(wo.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), "rows",
        F.sum("rows").over(wo.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("n"))
    wanted = ends.select("_bkt", "upto", "rows", "n", F.posexplode(F.array(*places)).alias("j", "place"))
    inside = wanted.where("place > upto - rows and place <= upto").select(
        "_bkt", "j", (F.col("place") - F.col("upto") + F.col("rows")).alias("k"))
    within = Window.partitionBy("_bkt").orderBy(*order)
    found = rows.join(inside.select("_bkt").distinct(), "_bkt", "left_semi") \
        .withColumn("k", F.row_number().over(within)).join(inside, ["_bkt", "k"]) \
        .select("j", F.struct(*order).alias("key"))
    return wanted.groupBy("j").agg(F.max("n").alias("n")).join(found, "j", "left").select("j", "key", "n")
