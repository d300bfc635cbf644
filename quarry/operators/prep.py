"""Preparation pipeline: exclusion, imputation, scaling, encoding, PCA
(SURVEY C1-C18).

``fit_prep`` learns every parameter from the TRAINING rows only (decision S2)
in two aggregate jobs – imputation values, then scaling statistics of the
imputed columns – and keeps them as a small ``PrepModel`` (one entry per
column, one per category). ``PrepModel.transform`` inlines the parameters as
literals. Categories and classes stay tables: one dictionary (column, value, code)
with distributed ranks, written to the shared checkpoint folder, from which codes
are joined; no dictionary passes through the driver unless its names are asked for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.ranking import sorted_codes
from quarry.functions.stats import quoted
from quarry.operators import profile as P
from quarry.session import cut_lineage

NULL_DROP_PCT = 50.0
#: Dictionaries of at most so many codes are broadcast; larger ones are joined by size.
FEW_CODES = 1000
DEFAULT_EXCLUDE_ROLES = ("id_like", "text", "datetime")
DEFAULT_EXCLUDE_MAX = 5
NUM_IMPUTE = ("median", "mean", "most_frequent", "constant")
CAT_IMPUTE = ("most_frequent", "constant")
SCALERS = ("standard", "minmax", "robust", "none")
ENCODERS = ("onehot", "label", "ordinal")


@dataclass(frozen=True)
class PrepSpec:
    target: str | None = None
    exclude: tuple[str, ...] = ()
    num_impute: str = "median"
    cat_impute: str = "most_frequent"
    scaler: str = "standard"
    encoder: str = "onehot"
    drop_null_pct: float = NULL_DROP_PCT


@dataclass
class PrepModel:
    spec: PrepSpec
    numeric: list[str]
    categorical: list[str]
    dropped: list[str]
    num_fill: dict[str, float]
    cat_fill: dict[str, str]
    center: dict[str, float]
    scale: dict[str, float]
    #: (name, value, code): categories of each column, and the target's classes under None
    codes: DataFrame
    #: number of codes of each name
    sizes: dict[str | None, int] = field(default_factory=dict)

    def dictionary(self, name: str | None) -> DataFrame:
        """(value, code) of a categorical column, or of the target (None)."""
        return self.codes.where(F.col("name").eqNullSafe(F.lit(name))).select("value", "code")

    @cached_property
    def categories(self) -> dict[str, list[str]]:
        """Sorted values of each column, on the driver: for names and wide tables only."""
        out: dict[str, list[str]] = {c: [] for c in self.categorical}
        for r in self.codes.where("name is not null").orderBy("name", "code").collect():
            out[r["name"]].append(r["value"])
        return out

    @cached_property
    def classes(self) -> list[str]:
        """Sorted classes of the target, on the driver."""
        return [r["value"] for r in self.dictionary(None).orderBy("code").collect()]

    @property
    def n_classes(self) -> int:
        return self.sizes.get(None, 0)

    # -- C15 ---------------------------------------------------------------------
    @property
    def feature_names(self) -> list[str]:
        names = list(self.numeric)
        for c in self.categorical:
            if self.spec.encoder == "onehot":
                names += [f"{c}_{v}" for v in self.categories[c]]
            else:
                names.append(c)
        return names

    # -- C4-C13 ----------------------------------------------------------------------
    def num_expr(self, c: str) -> Column:
        # new rows of a column recast by C3 may hold what is no number: imputed like NULL
        x = F.coalesce(F.col(c).try_cast("double"), F.lit(self.num_fill[c]))
        if self.spec.scaler == "none":
            return x
        return (x - F.lit(self.center[c])) / F.lit(self.scale[c])

    def cat_value(self, c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(self.cat_fill[c]))

    def cat_exprs(self, c: str) -> list[Column]:
        v = self.cat_value(c)
        cats = self.categories[c]
        if self.spec.encoder == "onehot":
            return [(v == F.lit(k)).cast("double").alias(f"{c}_{k}") for k in cats]
        code = F.col(f"_code_{c}")
        if self.spec.encoder == "ordinal":
            code = F.when(code.isNull(),
                          F.raise_error(F.concat(F.lit(f"unknown category in {c}: "), v))
                          ).otherwise(code)
            return [code.cast("double").alias(c)]
        return [F.coalesce(code, F.lit(-1.0)).alias(c)]

    def _coded(self, df: DataFrame, value: Column, of: str | None, name: str) -> DataFrame:
        """``df`` with the code of ``value`` (NULL if it is unknown): a join with
        the dictionary. One of few codes is broadcast: by so few keys the rows would
        be exchanged into as few tasks, however many they are."""
        rows = self.dictionary(of).select(F.col("value").alias(f"{name}_v"), F.col("code").cast("double").alias(name))
        rows = F.broadcast(rows) if self.sizes.get(of, 0) <= FEW_CODES else rows
        return df.join(rows, value == F.col(f"{name}_v"), "left").drop(f"{name}_v")

    def vectors(self, df: DataFrame, keep: Sequence[str] = (), with_label: bool = True) -> DataFrame:
        """C10/C13 for any number of categories: kept columns, ``features`` (numeric
        columns, then one sparse place for each category; an unknown one has none)
        and the label. The plan does not grow with the categories: codes are joined,
        and the encoder knows its sizes from column metadata, without a pass."""
        from pyspark.ml.feature import OneHotEncoder, VectorAssembler
        t = self.spec.target if with_label else None
        cols = [F.col(k) for k in keep] + [self.num_expr(c).alias(f"_n{i}") for i, c in enumerate(self.numeric)]
        for i, c in enumerate(self.categorical):
            df = self._coded(df, self.cat_value(c), c, f"_code{i}")
            size = self.sizes.get(c, 0)
            cols.append(F.coalesce(f"_code{i}", F.lit(float(size))).alias(
                f"_c{i}", metadata={"ml_attr": {"type": "nominal", "num_vals": max(size, 1)}}))
        if t:
            df = self._coded(df, F.col(t).cast("string"), None, "_code")
            cols.append(F.col("_code").alias("label"))
        out = df.select(*cols)
        out = out.where(F.col("label").isNotNull()) if t else out
        places = range(len(self.categorical))
        if self.categorical:
            encoder = OneHotEncoder(inputCols=[f"_c{i}" for i in places], outputCols=[f"_v{i}" for i in places],
                                    handleInvalid="keep", dropLast=True)
            out = encoder.fit(out).transform(out)
        inputs = [f"_n{i}" for i in range(len(self.numeric))] + [f"_v{i}" for i in places]
        out = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep").transform(out)
        return out.select(*keep, "features", *(["label"] if t else []))

    def transform(self, df: DataFrame, keep: Sequence[str] = (), with_label: bool = True) -> DataFrame:
        """Kept columns + features (+ encoded ``label`` unless scoring)."""
        cols = [F.col(k) for k in keep]
        cols += [self.num_expr(c).alias(c) for c in self.numeric]
        for c in self.categorical:
            if self.spec.encoder != "onehot":
                df = self._coded(df, self.cat_value(c), c, f"_code_{c}")
            cols += self.cat_exprs(c)
        t = self.spec.target if with_label else None
        if t:
            df = self._coded(df, F.col(t).cast("string"), None, "_code")
            cols.append(F.col("_code").alias("label"))
        out = df.select(*cols)
        return out.where(F.col("label").isNotNull()) if t else out


def default_exclusions(prof: P.TableProfile) -> list[str]:
    """Id-like, text and datetime columns, at most the first five."""
    return [c for c in prof.order if prof.roles[c] in DEFAULT_EXCLUDE_ROLES][:DEFAULT_EXCLUDE_MAX]


def recast_numeric_categoricals(df: DataFrame, cols: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Categorical string columns whose every non-NULL value parses as a
    number become double. Returns the frame and the recast columns."""
    cols = list(cols)
    if not cols:
        return df, []
    r = df.agg(*[F.every(F.col(c).isNull() | F.col(c).try_cast("double").isNotNull()).alias(f"_a{i}")
                 for i, c in enumerate(cols)]).first()
    rec = [c for i, c in enumerate(cols) if r[f"_a{i}"]]
    return df.withColumns({c: F.col(c).try_cast("double") for c in rec}), rec


def _typed_modes(df: DataFrame, cols: Sequence[str], as_double: bool) -> dict:
    """Most frequent value per column, smallest on ties, computed from
    partially aggregated value counts (no value map in one task)."""
    out = {}
    if not cols:
        return out
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("v"), (F.col(c).cast("double") if as_double else F.col(c).cast("string"))
                 .alias("x")) for c in cols])).alias("p")).select("p.*").where(F.col("x").isNotNull())
    vc = long.groupBy("v", "x").agg(F.count(F.lit(1)).alias("n"))
    for r in vc.groupBy("v").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("x").alias("x")))["x"]
                                 .alias("m")).collect():
        out[r["v"]] = r["m"]
    return out


def fit_prep(df: DataFrame, spec: PrepSpec, prof: P.TableProfile | None = None,
             train_filter: Column | None = None, checkpoint: bool = True) -> PrepModel:
    """Fit all parameters on the training rows (``train_filter``).

    Fitting takes ~10 small aggregate passes over the training rows; with
    ``checkpoint`` the (column-pruned) training rows are written once to the
    shared checkpoint folder, so the passes re-read them instead of
    replaying the upstream joins/windows, and a lost executor does not
    trigger a replay either.
    """
    train = df.where(train_filter) if train_filter is not None else df
    if checkpoint:
        train = cut_lineage(train)
    own_prof = prof is None
    prof = prof or P.collect_profile(train)
    excl = set(spec.exclude) | ({spec.target} if spec.target else set())
    # null shares of the training rows: already in a profile made here
    null_pct = (prof.null_pct if own_prof else
                {r["column_name"]: r["null_pct"] for r in P.null_profile(train).collect()})
    dropped = [c for c, v in null_pct.items()
               if v is not None and v > spec.drop_null_pct and c not in excl]
    keep = [c for c in prof.order if c not in excl and c not in dropped]
    numeric = [c for c in keep if prof.roles[c] == "numeric"]
    categorical = [c for c in keep if prof.roles[c] == "categorical"]
    # Wholly numeric categoricals become numeric
    num_strs = [c for c in categorical if prof.dtypes[c] == "string"]
    _, rec = recast_numeric_categoricals(train.select(*num_strs), num_strs) if num_strs else (None, [])
    categorical = [c for c in categorical if c not in rec]
    numeric = numeric + rec

    # phase 1: imputation values
    num_fill: dict[str, float] = {}
    if numeric:
        if spec.num_impute == "median":
            q = {r["variable"]: r["q"][0] for r in P.quantiles(
                train, numeric, [0.5]).collect()}
            num_fill = {c: float(q[c]) if q.get(c) is not None else 0.0 for c in numeric}
        elif spec.num_impute == "mean":
            r = train.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in numeric]).first()
            num_fill = {c: float(r[c]) if r[c] is not None else 0.0 for c in numeric}
        elif spec.num_impute == "most_frequent":
            m = _typed_modes(train, numeric, as_double=True)
            num_fill = {c: float(m.get(c, 0.0)) for c in numeric}
        else:
            num_fill = {c: 0.0 for c in numeric}
    if spec.cat_impute == "most_frequent":
        m = _typed_modes(train, categorical, as_double=False)
        cat_fill = {c: m.get(c, "missing") for c in categorical}
    else:
        cat_fill = {c: "missing" for c in categorical}

    # phase 2: scaling statistics of the imputed training columns
    center: dict[str, float] = {}
    scale: dict[str, float] = {}
    if numeric and spec.scaler != "none":
        imp = train.select(*[F.coalesce(F.col(c).cast("double"), F.lit(num_fill[c])).alias(c)
                             for c in numeric])
        if spec.scaler == "standard":
            r = imp.agg(*[e for c in numeric for e in (F.avg(c).alias(f"m_{c}"),
                                                       F.stddev_pop(c).alias(f"s_{c}"))]).first()
            for c in numeric:
                center[c] = float(r[f"m_{c}"])
                s = r[f"s_{c}"]
                scale[c] = float(s) if s else 1.0  # constant column -> 0 after centring
        elif spec.scaler == "minmax":
            r = imp.agg(*[e for c in numeric for e in (F.min(c).alias(f"lo_{c}"),
                                                       F.max(c).alias(f"hi_{c}"))]).first()
            for c in numeric:
                lo, hi = float(r[f"lo_{c}"]), float(r[f"hi_{c}"])
                center[c] = lo
                scale[c] = (hi - lo) if hi != lo else 1.0
        elif spec.scaler == "robust":
            q = {x["variable"]: x["q"] for x in P.quantiles(
                imp, numeric, [0.25, 0.5, 0.75]).collect()}
            for c in numeric:
                q25, med, q75 = q[c]
                center[c] = float(med)
                scale[c] = float(q75 - q25) if q75 != q25 else 1.0
    # categories of the imputed training values and classes of all rows, with their sorted places
    name = F.lit(None).cast("string")
    values = [train.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.coalesce(
        F.col(c).cast("string"), F.lit(cat_fill[c])).alias("value")) for c in categorical))))] if categorical else []
    if spec.target:
        values.append(df.select(name.alias("name"), F.col(spec.target).cast("string").alias("value")))
    if not values:
        values = [df.sparkSession.createDataFrame([], "name string, value string")]
    codes = cut_lineage(sorted_codes(reduce(DataFrame.unionByName, values), ["name"], "value"))
    sizes = {r["name"]: r["n"] for r in codes.groupBy("name").agg(F.count("*").alias("n")).collect()}  # a row a column
    return PrepModel(spec, numeric, categorical, dropped, num_fill, cat_fill, center, scale, codes, sizes)


def dictionary_encode(df: DataFrame, col: str, train: DataFrame, unknown: float = -1.0,
                      n_buckets: int | None = None) -> DataFrame:
    """C11 for one column without a model: the dictionary (value -> sorted code) of
    ``train`` is ranked over ranges and joined back; the join strategy is left to
    Catalyst/AQE (broadcast only when the measured size allows)."""
    dic = sorted_codes(train.select(F.col(col).cast("string").alias("_v")), [], "_v") \
        .withColumn("_code", F.col("code").cast("double")).drop("code")
    out = df.join(dic, F.col(col).cast("string") == F.col("_v"), "left")
    return out.withColumn(col, F.coalesce("_code", F.lit(unknown))).drop("_v", "_code")


def target_dictionary(df: DataFrame, target: str) -> DataFrame:
    """(class, code) in sorted class order, however many classes."""
    return sorted_codes(df.select(F.col(target).cast("string").alias("class")), [], "class").withColumn(
        "code", F.col("code").cast("int"))


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shape, null cells and role counts of two tables, one row each."""
    rows = []
    for stage, d in (("before", before), ("after", after)):
        s = P.dataset_shape(d).select(F.lit(stage).alias("stage"), "n_rows", "n_cols",
                                      "n_numeric", "n_categorical", "n_null_cells")
        rows.append(s)
    return rows[0].unionByName(rows[1])


def dtype_counts(df: DataFrame, stage: str) -> DataFrame:
    """(stage, dtype, n_columns): how many columns have each type. Types are
    metadata, so this reads no rows."""
    kinds = [t for _, t in df.dtypes]
    return df.sparkSession.createDataFrame([(stage, t, kinds.count(t)) for t in sorted(set(kinds))],
                                           "stage string, dtype string, n_columns long")


def pca_fit_transform(df: DataFrame, features: Sequence[str], k: int, keep: Sequence[str] = ()):
    """PCA on explicitly centred features (Spark's PCA does not
    centre); each component's sign is fixed so its largest-magnitude
    loading is positive. Returns (projected frame with PC1..PCk,
    explained-variance ratios)."""
    from pyspark.ml.feature import PCA, VectorAssembler
    from pyspark.ml.functions import vector_to_array
    feats = list(features)
    means = df.agg(*[F.avg(c).alias(c) for c in feats]).first()
    cen = df.select(*keep, *[(F.col(c) - F.lit(float(means[c] or 0.0))).alias(c) for c in feats])
    va = VectorAssembler(inputCols=feats, outputCol="_x", handleInvalid="keep")
    model = PCA(k=k, inputCol="_x", outputCol="_pc").fit(va.transform(cen))
    pcm = model.pc.toArray()  # d x k, small
    signs = []
    for j in range(pcm.shape[1]):
        col = pcm[:, j]
        signs.append(1.0 if col[abs(col).argmax()] >= 0 else -1.0)
    out = model.transform(va.transform(cen)).select(
        *keep, *[(vector_to_array("_pc")[j] * signs[j]).alias(f"PC{j + 1}") for j in range(k)])
    return out, [float(v) for v in model.explainedVariance.toArray()]
