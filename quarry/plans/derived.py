"""Derived inputs: the same table built with the DataFrame API and in SQL.

The driver tables hold no NULLs and no mixed-type strings, so the inputs the
profiling and preparation operators need (missing values, numeric strings,
a labelled score table, feature columns) are derived here from the driver
tables with joins and expressions only: every derived table keeps all rows
of its source and grows with it.

Each entry has a Spark builder ``f(spark, sf_dir) -> DataFrame`` and a SQL
text that DuckDB (or Spark SQL) can run against the driver tables as views.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.sources.tables import read_table

EMB_DIM = 64
FEATS = [f"f{i}" for i in range(EMB_DIM)]


def doc_labelled(spark: SparkSession, sf: str) -> DataFrame:
    """documents LEFT JOIN labels: quality/toxic are NULL for unlabelled docs."""
    docs = read_table(spark, sf, "documents")
    labels = read_table(spark, sf, "labels")
    return docs.join(labels, "doc_id", "left")


def orders_ret(spark: SparkSession, sf: str) -> DataFrame:
    """orders LEFT JOIN the per-order aggregate of returned line items.

    Orders without a returned line get NULL ``ret_qty``/``ret_lines``/
    ``ret_status``. The aggregate is keyed by the join key, so the join
    reuses its hash partitioning (one exchange on the orders side only).
    """
    li = read_table(spark, sf, "lineitem")
    ret = (li.where(F.col("l_returnflag") == "R")
             .groupBy(F.col("l_orderkey").alias("o_orderkey"))
             .agg(F.sum("l_quantity").alias("ret_qty"),
                  F.count(F.lit(1)).alias("ret_lines"),
                  F.max("l_linestatus").alias("ret_status")))
    return read_table(spark, sf, "orders").join(ret, "o_orderkey", "left")


def orders_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Mixed numeric/categorical table with target ``o_orderstatus``."""
    cust = read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment")
    return (orders_ret(spark, sf).join(cust, "o_custkey")
            .select("o_orderkey", "o_totalprice", "c_acctbal", "ret_qty",
                    "o_orderpriority", "c_mktsegment", "ret_status",
                    "o_orderstatus"))


def events_str(spark: SparkSession, sf: str) -> DataFrame:
    """String-typed view of events: numeric and date strings next to text."""
    ev = read_table(spark, sf, "events")
    return ev.select(
        "event_id",
        F.get_json_object("props", "$.k").alias("k_str"),
        F.col("value").cast("string").alias("value_str"),
        F.col("ts").cast("string").alias("ts_str"),
        F.when(F.col("event_type") == "error", F.lit("n/a"))
         .otherwise(F.col("value").cast("string")).alias("value_or_na"),
        "event_type",
        "props",
    )


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """Rule-scored line items: a labelled prediction table needing no model.

    label = class code of ``l_returnflag`` (A=0, N=1, R=2 in sorted order),
    prediction = a discount/tax rule, p0..p2 = class scores summing to 1,
    split = hash split on the row key (train/val/test).
    """
    li = read_table(spark, sf, "lineitem")
    # (orderkey, linenumber) repeats in the driver data; with part and
    # supplier the key is unique
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in
                             ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    p0 = F.col("l_discount") * 5
    p1 = F.col("l_tax") * 5
    return li.select(
        key.alias("key"),
        F.when(F.col("l_returnflag") == "A", 0)
         .when(F.col("l_returnflag") == "N", 1).otherwise(2).cast("double").alias("label"),
        F.when(F.col("l_discount") >= 0.07, 0)
         .when(F.col("l_tax") >= 0.04, 1).otherwise(2).cast("double").alias("prediction"),
        p0.alias("p0"), p1.alias("p1"), (1 - p0 - p1).alias("p2"),
        (F.col("l_linestatus") == "F").cast("double").alias("bin_label"),
        (F.col("l_discount") * 10).alias("bin_score"),
        F.when(F.col("l_discount") >= 0.05, 1.0).otherwise(0.0).alias("bin_pred"),
        _hash_split(key),
    )


def _hash_split(key) -> "F.Column":
    # md5 hex prefix against fixed cut strings: 0x0000-0xb332 train (70 %),
    # 0xb333-0xd998 val (15 %), rest test. A narrow map, no shuffle.
    h = F.substring(F.md5(F.concat_ws("|", F.lit("42"), key.cast("string"))), 1, 4)
    return (F.when(h < "b333", "train").when(h < "d999", "val")
             .otherwise("test").alias("split"))


def emb_features(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings expanded to f0..f63 double feature columns."""
    emb = read_table(spark, sf, "embeddings")
    return emb.select("vec_id",
                      *[F.col("embedding")[i].cast("double").alias(f"f{i}")
                        for i in range(EMB_DIM)],
                      F.col("label").cast("bigint").alias("label"))


def customer_rfm(spark: SparkSession, sf: str) -> DataFrame:
    """Per-customer recency / frequency / monetary features."""
    orders = read_table(spark, sf, "orders")
    last_day = orders.select(F.max("o_orderdate")).scalar()
    agg = (orders.groupBy(F.col("o_custkey").alias("c_custkey"))
           .agg(F.count(F.lit(1)).alias("n_orders"),
                F.sum("o_totalprice").alias("total_spent"),
                F.max("o_orderdate").alias("last_order")))
    cust = read_table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return (cust.join(agg, "c_custkey", "left")
            .select("c_custkey", "n_orders", "total_spent",
                    F.datediff(last_day, F.col("last_order")).cast("double")
                     .alias("last_order_days"),
                    "c_acctbal"))


def doc_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Numeric/categorical facts of labelled documents, target ``quality``."""
    # the facts come before the join: texts would be exchanged with it
    docs = read_table(spark, sf, "documents").select(
        "doc_id", F.col("n_chars").cast("double").alias("n_chars"),
        F.size(F.split(F.trim("text"), r"\s+")).cast("double").alias("words"),
        F.size(F.split("text", "\n")).cast("double").alias("lines"), "lang", "source")
    labels = read_table(spark, sf, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return docs.join(labels, "doc_id")


BUILDERS = {
    "doc_labelled": doc_labelled,
    "orders_ret": orders_ret,
    "orders_wide": orders_wide,
    "events_str": events_str,
    "scored": scored,
    "emb_features": emb_features,
    "customer_rfm": customer_rfm,
    "doc_quality": doc_quality,
}


def build(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return BUILDERS[name](spark, sf)


# --- SQL twins (DuckDB dialect, also valid Spark SQL unless noted) ---------

_SPLIT_SQL = """CASE WHEN substr(md5(concat_ws('|', '42', CAST({k} AS VARCHAR))), 1, 4) < 'b333' THEN 'train'
            WHEN substr(md5(concat_ws('|', '42', CAST({k} AS VARCHAR))), 1, 4) < 'd999' THEN 'val'
            ELSE 'test' END"""

SQL = {
    "doc_labelled": """
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "orders_ret": """
SELECT o.*, r.ret_qty, r.ret_lines, r.ret_status
FROM orders o LEFT JOIN (
  SELECT l_orderkey, sum(l_quantity) AS ret_qty, count(*) AS ret_lines,
         max(l_linestatus) AS ret_status
  FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) r
ON o.o_orderkey = r.l_orderkey""",
    "orders_wide": """
SELECT o.o_orderkey, o.o_totalprice, c.c_acctbal, o.ret_qty, o.o_orderpriority,
       c.c_mktsegment, o.ret_status, o.o_orderstatus
FROM orders_ret o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "events_str": """
SELECT event_id, json_extract_string(props, '$.k') AS k_str,
       CAST(value AS VARCHAR) AS value_str, CAST(ts AS VARCHAR) AS ts_str,
       CASE WHEN event_type = 'error' THEN 'n/a' ELSE CAST(value AS VARCHAR) END AS value_or_na,
       event_type, props
FROM events""",
    "scored": f"""
SELECT concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS key,
       CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS DOUBLE) AS label,
       CAST(CASE WHEN l_discount >= 0.07 THEN 0 WHEN l_tax >= 0.04 THEN 1 ELSE 2 END AS DOUBLE) AS prediction,
       l_discount * 5 AS p0, l_tax * 5 AS p1, 1 - l_discount * 5 - l_tax * 5 AS p2,
       CAST(l_linestatus = 'F' AS DOUBLE) AS bin_label,
       l_discount * 10 AS bin_score,
       CASE WHEN l_discount >= 0.05 THEN 1.0 ELSE 0.0 END AS bin_pred,
       {_SPLIT_SQL.format(k="concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR))")} AS split
FROM lineitem""",
    "emb_features": "SELECT vec_id, "
    + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}" for i in range(EMB_DIM))
    + ", CAST(label AS BIGINT) AS label FROM embeddings",
    "customer_rfm": """
SELECT c.c_custkey, a.n_orders, a.total_spent,
       CAST(date_diff('day', a.last_order, (SELECT max(o_orderdate) FROM orders)) AS DOUBLE) AS last_order_days,
       c.c_acctbal
FROM customer c LEFT JOIN (
  SELECT o_custkey, count(*) AS n_orders, sum(o_totalprice) AS total_spent,
         max(o_orderdate) AS last_order
  FROM orders GROUP BY o_custkey) a ON c.c_custkey = a.o_custkey""",
    "doc_quality": r"""
SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars,
       CAST(len(regexp_split_to_array(trim(d.text), '\s+')) AS DOUBLE) AS words,
       CAST(len(string_split(d.text, chr(10))) AS DOUBLE) AS lines,
       d.lang, d.source, CAST(l.quality AS VARCHAR) AS quality
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}

# Dependencies between derived tables (for CTE assembly).
DEPENDS = {"orders_wide": ["orders_ret"]}


def with_sql(*names: str) -> str:
    """``WITH`` clause defining the named derived tables (deps first)."""
    order: list[str] = []

    def add(n):
        for d in DEPENDS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + "\n"
