"""Column expressions for exact statistics (JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DP = 4  # decimals kept in reported statistics


# Decimal notation only: Java's casts would also take suffixes such as 1d or 2f.
NUMBER = r"^\s*[+-]?((\d+\.?\d*|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"


def quoted(name: str) -> Column:
    """The column of that very name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def number(c: Column) -> Column:
    """A string's number, or NULL."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def rnd(c: Column, dp: int = DP) -> Column:
    return F.round(c.cast("double"), dp)


def skew_g1(c: Column) -> Column:
    """Bias-corrected sample skewness G1 (pandas ``Series.skew``).

    Spark's ``skewness`` is the population g1; G1 = g1 * sqrt(n(n-1)) / (n-2).
    NULL below 3 values, 0 for a constant column (pandas convention).
    """
    n = F.count(c).cast("double")
    g1 = F.skewness(c)
    return (F.when(n < 3, F.lit(None).cast("double"))
             .when(F.stddev_pop(c) == 0, F.lit(0.0))
             .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def kurt_g2(c: Column) -> Column:
    """Bias-corrected excess kurtosis G2 (pandas ``Series.kurt``).

    G2 = (n-1)/((n-2)(n-3)) * ((n+1) g2 + 6) with g2 = Spark ``kurtosis``
    (population excess kurtosis). NULL below 4 values, 0 for constants.
    """
    n = F.count(c).cast("double")
    g2 = F.kurtosis(c)
    return (F.when(n < 4, F.lit(None).cast("double"))
             .when(F.stddev_pop(c) == 0, F.lit(0.0))
             .otherwise((n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)))


def nan_to_null(df, cols=None):
    """Entry rule: float NaN becomes NULL so only NULL means missing."""
    from pyspark.sql.types import DoubleType, FloatType
    targets = [f.name for f in df.schema.fields
               if isinstance(f.dataType, (DoubleType, FloatType))
               and (cols is None or f.name in cols)]
    if not targets:
        return df
    return df.withColumns({c: F.nanvl(quoted(c), F.lit(None).cast("double"))
                           .cast(df.schema[c].dataType) for c in targets})
