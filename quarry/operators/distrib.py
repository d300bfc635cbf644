"""Distributions, correlations, outliers and dataset insight rules."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import seeded_order
from quarry.functions.stats import quoted, rnd
from quarry.operators import profile as P

IQR_K = 1.5


# --- B16 null map ---------------------------------------------------------------

def null_map(df: DataFrame, key: str, n_rows: int = 200) -> DataFrame:
    """0/1 null indicator (row key x column) for the first n rows by key.

    The row cap is the feature (a bounded picture); TakeOrdered keeps n rows
    per task before merging.
    """
    head = df.orderBy(key).limit(n_rows)
    cols = [c for c in df.columns if c != key]
    return head.select(F.col(key).alias("row_key"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).isNull().cast("int").alias("is_null"))
        for c in cols])).alias("p")).select("row_key", "p.column_name", "p.is_null")


# --- B17 IQR outliers ----------------------------------------------------------------

def iqr_outliers(df: DataFrame, cols: Sequence[str], method: str = "bracket") -> DataFrame:
    """Per numeric column Tukey fences, outlier count and share.

    Quartiles come from one quantile job; the fences (one pair per column,
    bounded) are then inlined as literals into a single conditional-count
    aggregate – no join back to the data.
    """
    cols = list(cols)
    qs = {r["variable"]: r["q"] for r in P.quantiles(df, cols, [0.25, 0.75], method).collect()}
    keep = [c for c in cols if c in qs and qs[c] is not None and qs[c][1] - qs[c][0] != 0]
    if not keep:
        return df.sparkSession.createDataFrame(
            [], "variable string, n_outliers bigint, pct_outliers double, lower double, "
                "upper double, min double, max double")
    aggs = []
    for i, c in enumerate(keep):
        q1, q3 = qs[c]
        lo, hi = q1 - IQR_K * (q3 - q1), q3 + IQR_K * (q3 - q1)
        x = quoted(c).cast("double")
        aggs += [F.count(F.when((x < lo) | (x > hi), 1)).alias(f"_o{i}"),
                 F.count(x).alias(f"_n{i}"), F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
    wide = df.agg(*aggs)
    rows = []
    for i, c in enumerate(keep):
        q1, q3 = qs[c]
        lo, hi = q1 - IQR_K * (q3 - q1), q3 + IQR_K * (q3 - q1)
        rows.append(F.struct(
            F.lit(c).alias("variable"), F.col(f"_o{i}").alias("n_outliers"),
            F.round(F.col(f"_o{i}") * 100.0 / F.col(f"_n{i}"), 2).alias("pct_outliers"),
            rnd(F.lit(lo)).alias("lower"), rnd(F.lit(hi)).alias("upper"),
            rnd(F.col(f"_lo{i}")).alias("min"), rnd(F.col(f"_hi{i}")).alias("max")))
    return wide.select(F.inline(F.array(*rows)))


# --- B18 / B19 correlations -----------------------------------------------------------

def corr_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r for each pair i<j (pairwise-complete): (i, j, var_a, var_b, r);
    NULL where a column is constant on the pair's rows.

    One scan finds each column's least value, which is taken off so that sums
    stay small; a second one multiplies matrices per Arrow batch. A task sends
    its sums once (columns squared numbers), added per pair: the plan does not
    grow with the columns.
    """
    cols, spark = list(cols), df.sparkSession
    if len(cols) < 2:
        return spark.createDataFrame([], "i int, j int, var_a string, var_b string, r double")
    wide = df.select(*(quoted(c).cast("double").alias(f"c{k}") for k, c in enumerate(cols)))
    low = wide.agg(*(F.min(F.nanvl(f"c{k}", F.lit(None).cast("double"))) for k in range(len(cols)))).first()
    low = np.array([0.0 if v is None or not np.isfinite(v) else v for v in low])
    upper = np.triu_indices(len(cols), 1)
    names = ["n", "sa", "sb", "saa", "sbb", "sab"]

    def run(batches):
        total = None
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], axis=1) - low
            here = np.isfinite(x)
            x, m = np.where(here, x, 0.0), here.astype(float)
            q = x * x
            sums = np.stack([m.T @ m, x.T @ m, m.T @ x, q.T @ m, m.T @ q, x.T @ x])
            total = sums if total is None else total + sums
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), *(pa.array(t[upper]) for t in total)],
                ["i", "j", *names])

    sums = wide.mapInArrow(run, "i int, j int, " + ", ".join(f"{n} double" for n in names)) \
        .groupBy("i", "j").agg(*(F.sum(n).alias(n) for n in names))
    va, vb = F.expr("n * saa - sa * sa"), F.expr("n * sbb - sb * sb")
    # what rounding leaves of a constant is no variance
    fine = (va > 1e-12 * F.col("n") * F.col("saa")) & (vb > 1e-12 * F.col("n") * F.col("sbb"))
    pairs = spark.createDataFrame([(int(i), int(j), cols[i], cols[j]) for i, j in zip(*upper)],
                                  "i int, j int, var_a string, var_b string")
    # columns squared rows on either side
    return pairs.join(sums.select("i", "j", F.when(fine, F.try_divide(
        F.expr("n * sab - sa * sb"), F.sqrt(va) * F.sqrt(vb))).alias("r")), ["i", "j"], "left")


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Full (mirrored) matrix in long form: (var_a, var_b, r) 4 dp."""
    p = corr_pairs(df, cols)
    mirror = p.select(F.col("var_b").alias("var_a"), F.col("var_a").alias("var_b"), "r")
    diag = df.sparkSession.createDataFrame([(c,) for c in cols], "var_a string").select(
        "var_a", F.col("var_a").alias("var_b"), F.lit(1.0).alias("r"))
    return (p.select("var_a", "var_b", "r").unionByName(mirror).unionByName(diag)
            .select("var_a", "var_b", rnd(F.col("r")).alias("r")))


def top_corr_pairs(df: DataFrame, cols: Sequence[str], n: int = 10) -> DataFrame:
    """Pairs ranked by |r| desc (ties by names), top n, 4 dp."""
    p = corr_pairs(df, cols).where(F.col("r").isNotNull())
    w = Window.orderBy(F.desc(F.abs("r")), "var_a", "var_b")  # n(n-1)/2 rows: bounded
    return (p.select("var_a", "var_b", rnd(F.col("r")).alias("r"),
                     rnd(F.abs("r")).alias("abs_r"), F.row_number().over(w).alias("rank"))
            .where(F.col("rank") <= n))


# --- B20 / B21 class distribution ---------------------------------------------------

def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count and share per class (NULL excluded), with the class total."""
    vc = (df.where(F.col(target).isNotNull())
          .groupBy(F.col(target).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count")))
    # the class table is bounded by the number of classes
    tot = F.sum("count").over(Window.partitionBy())
    return vc.select("class", "count", F.round(F.col("count") * 100.0 / tot, 2).alias("pct"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Class count, dominant share and the balance grade."""
    d = class_distribution(df, target)
    s = d.agg(F.count(F.lit(1)).alias("n_classes"),
              F.max(F.col("count")).alias("_mx"), F.sum("count").alias("_n"))
    share = F.col("_mx") * 100.0 / F.col("_n")
    grade = (F.when(F.col("n_classes") == 2,
                    F.when(share > 80, "strong_imbalance").when(share > 60, "mild_imbalance")
                     .otherwise("balanced"))
              .otherwise(F.when(share > 70, "strong_imbalance").otherwise("acceptable")))
    return s.select("n_classes", F.round(share, 2).alias("max_pct"), grade.alias("grade"))


# --- B22 histogram ------------------------------------------------------------------

def histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Equal-width bins between min and max: (bin, lo, hi, count).

    The bin id is a pure expression of the row; the group-by is partially
    aggregated, so at most ``bins`` rows per task reach the shuffle.
    """
    x = F.col(col).cast("double")
    mm = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).first()
    lo, hi = mm["lo"], mm["hi"]
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, lo double, hi double, count bigint")
    width = (hi - lo) / bins
    b = (F.lit(0) if width == 0 else
         F.least(F.floor((x - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int"))
    h = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    return h.select("bin", rnd(F.lit(lo) + F.col("bin") * F.lit(width)).alias("lo"),
                    rnd(F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("hi"), "count")


# --- B23 box statistics ---------------------------------------------------------------

def box_stats(df: DataFrame, col: str, group: str | None = None) -> DataFrame:
    """Q1, median, Q3, mean, whiskers (extreme in-fence values) and the
    outlier count, per group. Fences are one row per group; how they are joined
    back for the whisker pass is left to their measured size."""
    x = F.col(col).cast("double")
    g = F.col(group).cast("string") if group else F.lit("all")
    base = df.select(g.alias("grp"), x.alias("x")).where(F.col("x").isNotNull())
    st = base.groupBy("grp").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))
    # exact quartiles by the memory-bounded rank route: a hot group with many
    # distinct values never sits in one task's map
    q = P.rank_quantiles_long(base.select(F.col("grp").alias("variable"), "x"),
                              [0.25, 0.5, 0.75]).withColumnRenamed("variable", "grp")
    f = st.join(q, "grp").select("grp", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                                 F.col("q")[2].alias("q3"), "mean", "n")
    f = f.withColumns({"lf": F.col("q1") - IQR_K * (F.col("q3") - F.col("q1")),
                       "uf": F.col("q3") + IQR_K * (F.col("q3") - F.col("q1"))})
    inside = (F.col("x") >= F.col("lf")) & (F.col("x") <= F.col("uf"))
    w = base.join(f.select("grp", "lf", "uf"), "grp").groupBy("grp").agg(
        F.min(F.when(inside, F.col("x"))).alias("lower_whisker"),
        F.max(F.when(inside, F.col("x"))).alias("upper_whisker"),
        F.count(F.when(~inside, 1)).alias("n_outliers"))
    return f.join(w, "grp").select(
        F.col("grp").alias("group"), "n", rnd(F.col("q1")).alias("q1"),
        rnd(F.col("median")).alias("median"), rnd(F.col("q3")).alias("q3"),
        rnd(F.col("mean")).alias("mean"), rnd(F.col("lower_whisker")).alias("lower_whisker"),
        rnd(F.col("upper_whisker")).alias("upper_whisker"), "n_outliers")


# --- B24 top categories ----------------------------------------------------------

def top_categories(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    """The k most frequent values of a categorical column."""
    return P.top_values(df, [col], k).select("value", "count", "rank")


# --- B25 seeded sample with colour codes -----------------------------------------

def seeded_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows chosen by md5(seed|key): reproducible and
    engine-neutral. TakeOrdered: each task keeps its n best rows."""
    return df.orderBy(seeded_order(seed, F.col(key)), key).limit(n)


def pair_sample(df: DataFrame, key: str, cols: Sequence[str], color: str | None = None,
                n: int = 500, seed: int = 42) -> DataFrame:
    """Sample for a pair plot, with integer colour codes of ``color``
    (dense rank of the sorted distinct values inside the bounded sample)."""
    s = seeded_sample(df.select(key, *cols, *([color] if color else [])), key, n, seed)
    if color:
        s = s.withColumn("color_code",
                         F.dense_rank().over(Window.orderBy(F.col(color).cast("string"))) - 1)
    return s


# --- B14 dataset insight rules ------------------------------------------------------

def insights(df: DataFrame, prof: "P.TableProfile | None" = None) -> DataFrame:
    """Rule table (rule, level, subject, value) over size, nulls,
    duplicates, dominant class of the first two candidate targets and
    |r| > 0.9 pairs (first three)."""
    spark = df.sparkSession
    prof = prof or P.collect_profile(df)
    n_rows, n_cols = prof.n_rows, len(prof.order)
    size = (spark.range(1).select(
        F.lit("size").alias("rule"),
        F.lit("warning" if n_rows < 100 else "info" if n_rows > 100000 else "ok").alias("level"),
        F.lit("small" if n_rows < 100 else "large" if n_rows > 100000 else "adequate")
        .alias("subject"), F.lit(float(n_rows)).alias("value")))
    nulls = P.null_profile(df).agg(F.sum("n_null").alias("z"))
    pct = F.col("z") * 100.0 / F.lit(n_rows * n_cols) if n_rows * n_cols else F.lit(None)
    nulls = nulls.select(
        F.lit("nulls").alias("rule"),
        F.when(pct == 0, "ok").when(pct < 30, "warning").otherwise("danger").alias("level"),
        F.when(pct == 0, "none").when(pct < 5, "few").when(pct < 30, "moderate")
         .otherwise("many").alias("subject"),
        F.round(pct, 1).alias("value"))
    dup = P.duplicate_rows(df).where(F.col("n_duplicates") > 0).select(
        F.lit("duplicates").alias("rule"), F.lit("warning").alias("level"),
        F.lit("rows").alias("subject"), F.col("n_duplicates").cast("double").alias("value"))
    parts = [size, nulls, dup]
    cands = [c for c in prof.order
             if (prof.roles[c] == "categorical" and 2 <= prof.n_unique[c] <= 20)]
    cands += [c for c in prof.order if prof.roles[c] == "numeric" and prof.n_unique[c] <= 20]
    for t in cands[:2]:
        cd = class_distribution(df, t).agg(F.count(F.lit(1)).alias("k"),
                                           (F.max("count") * 100.0 / F.sum("count")).alias("mx"))
        cb = cd.where((F.col("k") >= 2) & (F.col("mx") > 80))
        parts.append(cb.select(F.lit("imbalance").alias("rule"), F.lit("warning").alias("level"),
                               F.lit(t).alias("subject"), F.round("mx", 1).alias("value")))
    num = prof.cols("numeric")
    if len(num) >= 2:
        cp = corr_pairs(df, num).where(F.abs("r") > 0.9)
        cp = cp.withColumn("_k", F.row_number().over(Window.orderBy("i", "j"))).where("_k <= 3")
        parts.append(cp.select(F.lit("high_correlation").alias("rule"),
                               F.lit("info").alias("level"),
                               F.concat_ws("|", "var_a", "var_b").alias("subject"),
                               rnd(F.abs("r")).alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
