"""Train/validation/test splits, k-fold assignment and dummy baselines
(SURVEY D1-D10, F6 folds).

Every assignment is a pure function of (seed, key, class counts), so it is
reproducible, layout independent and survives recomputation after executor
loss. Only cut points are computed, never ranks of all rows: rows are counted per
(class, md5 prefix), the prefixes that hold a cut are refined, and a row is
assigned by comparing its md5 with the cuts of its class. No payload column is
exchanged while the cut table is small enough to broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.hashing import seeded_order, seeded_uniform
from quarry.functions.ranking import keys_at
from quarry.session import cut_lineage

SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class SplitPlan:
    """Shares in per mille, from the two sliders of the reference:
    train % and validation % of the rest (val = rest*v/100, test = rest*(100-v)/100)."""

    train_pct: int = 70
    val_of_rest: int = 50

    @property
    def train_pm(self) -> int:
        return self.train_pct * 10

    @property
    def val_pm(self) -> int:
        return (100 - self.train_pct) * self.val_of_rest // 10

    @property
    def test_pm(self) -> int:
        return 1000 - self.train_pm - self.val_pm

    def n_test(self, n: Column) -> Column:
        # ceil(n * test) – first cut, as the first train_test_split
        return F.floor((n * self.test_pm + 999) / 1000).cast("bigint")

    def n_val(self, rest: Column) -> Column:
        # ceil(rest * val / (train + val)) – second cut on the rest
        d = self.train_pm + self.val_pm
        return F.floor((rest * self.val_pm + d - 1) / d).cast("bigint")


def _assign(rank0: Column, n: Column, plan: SplitPlan, test_first: bool = True) -> Column:
    nt = plan.n_test(n)
    nv = plan.n_val(n - nt)
    if test_first:
        return (F.when(rank0 < nt, "test").when(rank0 < nt + nv, "val").otherwise("train"))
    # ordered split: train first, then val, then test last
    ntr = n - nt - nv
    return F.when(rank0 < ntr, "train").when(rank0 < ntr + nv, "val").otherwise("test")


#: Classes up to which the cuts (a few short strings a class) are broadcast.
BROADCAST_CLASSES = 10_000
PREFIX = 4


def md5_cuts(d: DataFrame, label: str, order: Column, ranks: Sequence[Column]) -> DataFrame:
    """(label, cuts): for each class the md5 strings of which the first one has
    ``ranks[0]`` rows up to and with it, and so on ('' for none). ``ranks`` are
    expressions in ``n``, the rows of the class.

    Three narrow steps: rows per (class, md5 prefix), a table of at most 65 536
    rows a class; the prefixes that hold a cut; the rows in those, ranked."""
    keyed = d.select(F.col(label).alias("c"), order.alias("o"))
    counts = keyed.groupBy("c", F.substring("o", 1, PREFIX).alias("p")).agg(F.count(F.lit(1)).alias("rows"))
    upto = F.sum("rows").over(Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.select("c", "p", (upto - F.col("rows")).alias("before"), upto.alias("upto"),
                           F.sum("rows").over(Window.partitionBy("c")).alias("n"))
    wanted = counts.select("c", "p", "before", F.posexplode(F.array(*ranks)).alias("j", "r"), "upto").where("before < r and r <= upto")
    rows = keyed.withColumn("p", F.substring("o", 1, PREFIX)).join(wanted.select("c", "p").distinct(), ["c", "p"])
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("c", "p").orderBy("o")))
    found = rows.join(wanted, ["c", "p"]).where("k = r - before").select("c", "j", "o")
    none = counts.select("c").distinct().select("c", F.explode(F.array(*map(F.lit, range(len(ranks))))).alias("j"))
    return none.join(found, ["c", "j"], "left").groupBy("c").agg(F.transform(F.array_sort(F.collect_list(
        F.struct("j", F.coalesce("o", F.lit("")).alias("o")))), lambda x: x["o"]).alias("cuts")) \
        .withColumnRenamed("c", label)


def _with_cuts(d: DataFrame, label: str, order: Column, ranks: Sequence[Column]) -> DataFrame:
    """``d`` with its class's ``_cuts``. The cut table has one row a class; it is
    counted, and broadcast only while it is small."""
    cuts = cut_lineage(md5_cuts(d, label, order, ranks)).withColumnRenamed("cuts", "_cuts")
    return d.join(F.broadcast(cuts) if cuts.count() <= BROADCAST_CLASSES else cuts, label)


def _split_at(order: Column) -> Column:
    return (F.when(order <= F.col("_cuts")[0], "test").when(order <= F.col("_cuts")[1], "val").otherwise("train"))


def _split_ranks(plan: SplitPlan) -> list[Column]:
    nt = plan.n_test(F.col("n"))
    return [nt, nt + plan.n_val(F.col("n") - nt)]


def stratified_split(df: DataFrame, key: str, label: str, plan: SplitPlan = SplitPlan(),
                     seed: int = 42) -> DataFrame:
    """Per class, in the order of md5(seed|key): the first ceil(n·test)
    rows go to test, the next ceil(rest·val/(train+val)) to val, the rest train.
    Rows with a NULL label are dropped (S3); rows with equal keys stay together."""
    d = df.where(F.col(label).isNotNull())
    order = seeded_order(seed, F.col(key))
    return _with_cuts(d, label, order, _split_ranks(plan)).withColumn("split", _split_at(order)) \
        .select(*df.columns, "split")


def shuffled_split(df: DataFrame, key: str, plan: SplitPlan = SplitPlan(), seed: int = 42) -> DataFrame:
    """Unstratified shuffled split with exact sizes: the same cuts, of all
    rows as one class; they are two literals in a narrow map."""
    order = seeded_order(seed, F.col(key))
    row = md5_cuts(df.withColumn("_all", F.lit(0)), "_all", order, _split_ranks(plan)).first()
    cuts = F.array(*map(F.lit, row["cuts"] if row else ["", ""]))
    return df.withColumn("_cuts", cuts).withColumn("split", _split_at(order)).select(*df.columns, "split")


def hash_split(df: DataFrame, key: str, plan: SplitPlan = SplitPlan(), seed: int = 42) -> DataFrame:
    """Shuffled split of approximate sizes as a narrow map without any pass
    before it: the md5 4-hex prefix is compared with fixed cut strings (for
    streams and for data whose size is not known)."""
    c1 = f"{65536 * plan.train_pm // 1000:04x}"
    c2 = f"{65536 * (plan.train_pm + plan.val_pm) // 1000:04x}"
    h = F.substring(seeded_order(seed, F.col(key)), 1, 4)
    return df.withColumn("split", F.when(h < c1, "train").when(h < c2, "val").otherwise("test"))


def hash_split_cuts(plan: SplitPlan = SplitPlan()) -> tuple[str, str]:
    return (f"{65536 * plan.train_pm // 1000:04x}",
            f"{65536 * (plan.train_pm + plan.val_pm) // 1000:04x}")


def ordered_split(df: DataFrame, order_col: str, plan: SplitPlan = SplitPlan(),
                  tie_breaker: Sequence[str] = ()) -> DataFrame:
    """D3: no shuffle – the first rows by (``order_col``, ``tie_breaker``) train,
    then val, the last rows test. Further ties go by a hash of the row, so that
    equal order values of any number are spread over tasks; rows equal in
    everything stay together. NULLs come first.

    Only the two keys at the cuts are searched, in range-partitioned order columns;
    the rows themselves are compared with them where they are."""
    names = {c: f"_k{i}" for i, c in enumerate([order_col, *tie_breaker])}
    whole = F.xxhash64(*df.columns).alias("_h")
    order = [*names.values(), "_h"]
    keyed = df.select(*(F.col(c).alias(n) for c, n in names.items()), whole)
    nt = plan.n_test(F.col("n"))
    nv = plan.n_val(F.col("n") - nt)
    cuts = keys_at(keyed, order, [F.col("n") - nt - nv, F.col("n") - nt])
    one = cut_lineage(cuts.groupBy(F.lit(0).alias("_one")).agg(
        *(F.max(F.when(F.col("j") == j, F.col("key"))).alias(f"_c{j}") for j in (0, 1))))  # a single row
    key = F.struct(*(F.col(c).alias(n) for c, n in names.items()), whole)
    split = F.when(key <= F.col("_c0"), "train").when(key <= F.col("_c1"), "val").otherwise("test")
    return df.withColumn("_one", F.lit(0)).join(F.broadcast(one), "_one").withColumn("split", split).select(*df.columns, "split")


def stratified_folds(df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42) -> DataFrame:
    """F6 folds: floor(rank·k/n) of the rank in the class by md5 order –
    stratified, seeded, by the same cuts as D1."""
    d = df.where(F.col(label).isNotNull())
    order = seeded_order(seed, F.col(key))
    ranks = [F.expr(f"({j} * n + {k - 1}) div {k}") for j in range(1, k)]
    fold = F.size(F.filter("_cuts", lambda c: c < order)) if k > 1 else F.lit(0)
    return _with_cuts(d, label, order, ranks).withColumn("fold", fold.cast("int")).select(*df.columns, "fold")


# --- D4-D6 reports ------------------------------------------------------------------

def split_sizes(df: DataFrame, plan: SplitPlan = SplitPlan()) -> DataFrame:
    """Planned share (1 dp) and truncated planned count next to the
    realised count and share per split."""
    g = df.groupBy("split").agg(F.count(F.lit(1)).alias("n"))
    tot = F.sum("n").over(Window.partitionBy())  # three rows
    pm = (F.when(F.col("split") == "train", plan.train_pm)
           .when(F.col("split") == "val", plan.val_pm).otherwise(plan.test_pm))
    return g.select("split", (pm / 10.0).alias("planned_pct"),
                    F.floor(tot * pm / 1000).cast("bigint").alias("planned_n"), "n",
                    F.round(F.col("n") * 100.0 / tot, 2).alias("pct"))


def class_share_by_split(df: DataFrame, label: str) -> DataFrame:
    """Class % within each split."""
    g = df.groupBy("split", F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("split", "class", "n",
                    F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("split")), 2)
                    .alias("pct"))


def stratification_check(df: DataFrame, label: str) -> DataFrame:
    """Max |train share - val share| over classes, and whether < 0.05."""
    g = df.where(F.col("split").isin("train", "val")).groupBy(label).pivot(
        "split", ["train", "val"]).agg(F.count(F.lit(1)))
    tr = F.coalesce(F.col("train"), F.lit(0))
    va = F.coalesce(F.col("val"), F.lit(0))
    s = g.select((tr / F.sum(tr).over(Window.partitionBy())).alias("st"),
                 (va / F.sum(va).over(Window.partitionBy())).alias("sv"))
    return s.agg(F.round(F.max(F.abs(F.col("st") - F.col("sv"))), 4).alias("max_diff")).select(
        "max_diff", (F.col("max_diff") < 0.05).alias("stratified_ok"))


# --- D7-D9 dummy baselines ------------------------------------------------------------

def fit_baseline(train: DataFrame, label: str) -> list[tuple[float, int]]:
    """Class counts of the training rows, sorted by class (bounded: k rows)."""
    rows = (train.where(F.col(label).isNotNull()).groupBy(label)
            .agg(F.count(F.lit(1)).alias("n")).orderBy(label).collect())
    return [(float(r[label]), int(r["n"])) for r in rows]


def baseline_predict(df: DataFrame, key: str, classes: list[tuple[float, int]],
                     strategy: str = "stratified", seed: int = 42) -> DataFrame:
    """D7 stratified / D8 most_frequent / D9 uniform predictions.

    u = seeded uniform of the key; the class table (k rows) is inlined as a
    CASE expression, so scoring is a narrow map.
    """
    pred = baseline_expr(seeded_uniform(seed, F.col(key)), classes, strategy)
    return df.withColumn("prediction", pred.cast("double"))


def baseline_expr(u, classes: list[tuple[float, int]], strategy: str):
    """The prediction of one baseline strategy for the uniform ``u``."""
    if strategy == "most_frequent":
        best = min(classes, key=lambda c: (-c[1], c[0]))[0]
        pred = F.lit(best)
    elif strategy == "uniform":
        k = len(classes)
        idx = F.least(F.floor(u * k), F.lit(k - 1))
        pred = F.lit(None).cast("double")
        for i, (c, _) in enumerate(reversed(classes)):
            pred = F.when(idx == (k - 1 - i), F.lit(c)).otherwise(pred)
    elif strategy == "stratified":
        total = sum(n for _, n in classes)
        cum, pred = 0, None
        for c, n in classes:
            cum += n
            cond = u < F.lit(cum / total)
            pred = F.when(cond, F.lit(c)) if pred is None else pred.when(cond, F.lit(c))
        pred = pred.otherwise(F.lit(classes[-1][0]))
    else:
        raise ValueError(f"unknown baseline strategy {strategy!r}")
    return pred.cast("double")
