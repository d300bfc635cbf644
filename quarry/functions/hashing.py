"""Seeded, engine-neutral hash expressions.

``md5(concat_ws('|', seed, key))`` gives the same string in Spark SQL and in
DuckDB, so seeded orders, samples and splits can be checked by SQL. Each is
a pure function of the row: recomputation after an executor loss yields the
same assignment (unlike ``rand()`` over a changed partitioning).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_order(seed: int, *keys: Column) -> Column:
    """md5 hex of 'seed|key1|key2…' – an order key independent of layout."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def seeded_uniform(seed: int, *keys: Column) -> Column:
    """u in [0, 1) from the first 13 hex digits (52 bits) of the md5."""
    h = seeded_order(seed, *keys)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / float(16 ** 13)


def seeded_order_sql(seed: int, *keys: str) -> str:
    ks = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"md5(concat_ws('|', '{seed}', {ks}))"


def seeded_uniform_sql(seed: int, *keys: str) -> str:
    # DuckDB: hex prefix -> integer via a '0x' literal string cast
    return (f"CAST(CAST(('0x' || substr({seeded_order_sql(seed, *keys)}, 1, 13)) AS BIGINT) "
            f"AS DOUBLE) / {float(16 ** 13)}")
