"""Operator 5: mixing sources to target weights by weighted fair queueing.

Sizes are words ``[^\\x20\\x09-\\x0D]+``. Sources in code point order (null
last) weigh 3, 1, 2, repeating. All targets together are ``SHARE`` of all sizes;
a target stops at ``REPEATS`` times its source's size and the excess is reshared
by weight: targets are ``least(2 * size, level * weight)``, and the level comes
from running sums over the sources ordered by ``size / weight``.

Each source's documents are shuffled by a seeded digest of doc_id and queued
once or twice; a queued copy's virtual finish time is the words of its source up
to and with it, divided by the source's target. The copies are range-sorted by
finish time over all sources and cut where the running total would pass the
budget. Running sums go bucket by bucket (totals of a bounded number of buckets,
then a window within each), so neither a hot source nor the global order ever
meets in one task. The cut is one number: the last finish time that fits.

A row is named by digests of doc_id, source and text and its number among the rows
that share them, so that each row of the mix is taken as often as its own place in
the queue says, whatever its doc_id.

A null text has size 0; size 0 is never taken. A null source is a source of its
own, the last. Rows without a doc_id share one shuffle key; they are queued by
size, then by digest, in buckets of their own. Repeated rows are documents of
their own; rows equal in doc_id, source and text meet in one task of the mix.
An empty table gives an empty result. Same rows, same result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.hashing import seeded_order
from quarry.llm.columns import hidden, shown
from quarry.llm.storage import Stage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2
SEED = 11
#: Buckets: hex digits of the shuffle key within a source; per unit of finish time.
DIGITS = 3
PER_UNIT = 4096
#: Finish times from here on share a bucket (targets far below one document).
LAST_BUCKET = 1 << 20
#: Sizes of rows without a doc_id from here on share buckets, 64 for each doubling.
LARGE = 1 << 12
_NO_ID = hashlib.md5(f"{SEED}|".encode()).hexdigest()


def identity() -> list[Column]:
    """Two digests of doc_id, source and text."""
    doc_id, source = F.col("doc_id").cast("long"), F.col("source").cast("string")
    return [F.xxhash64(F.lit(k), doc_id.isNull(), doc_id, source.isNull(), source, F.col("text").cast("string")).alias(f"i{k}")
            for k in (1, 2)]


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, shuffle key and identity of each row."""
    return docs.select(
        F.col("doc_id").cast("long"), F.col("source").cast("string"),
        F.coalesce(F.expr(r"regexp_count(text, '[^\\x20\\x09-\\x0D]+')"), F.lit(0)).cast("long").alias("size"),
        seeded_order(SEED, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("key"), *identity())


def targets(sized: DataFrame) -> DataFrame:
    """(source, source_size, target): one row per source."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.row_number().over(order) - 1) % len(WEIGHTS) + 1))
    by_need = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("source_size").over(by_need.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(by_need.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    level = (F.lit(SHARE) * F.sum("source_size").over(everything) - REPEATS * before) / rest
    return per.withColumn("level", level).withColumn("level", F.max("level").over(everything)).select(
        "source", "source_size",
        F.least(F.col("source_size") * float(REPEATS), F.col("level") * F.col("weight")).alias("target"))


def _bucket() -> Column:
    """A prefix of the order of the queue. Rows without a doc_id have one key, so theirs is of size and digest."""
    start = F.substring("key", 1, DIGITS)
    large = F.lit(LARGE) + F.floor(64 * (F.log2("size") - F.log2(F.lit(LARGE))))
    own = F.when(F.col("size") < LARGE, F.col("size") * 16 + F.shiftright("i1", 60) + 8).otherwise(large * 16)
    beside = F.when(F.col("key") < _NO_ID, "0").when(F.col("key") > _NO_ID, "2").otherwise(
        F.concat(F.lit("1"), F.lpad(own.cast("string"), 8, "0")))
    return F.when(start == _NO_ID[:DIGITS], F.concat(start, beside)).otherwise(start)


def queued(sized: DataFrame) -> DataFrame:
    """``sized`` with source_size, target and ``upto``: the words of the source
    up to and with the row, in shuffled order."""
    sized = sized.withColumn("bucket", _bucket())
    per = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    known = offsets.alias("o").join(F.broadcast(targets(sized)).alias("t"), F.expr("o.source <=> t.source")) \
        .select("o.source", "bucket", "offset", "source_size", "target")
    rows = sized.alias("d").join(known.alias("k"), F.expr("d.source <=> k.source and d.bucket = k.bucket")) \
        .select("d.*", "offset", "source_size", "target")
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "i1", "i2") \
        .rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("upto", F.col("offset") + F.sum("size").over(inside)).drop("bucket", "offset")


def _finish(copy):
    return F.try_divide(F.col("upto") + copy * F.col("source_size"), F.col("target"))


def cut(queue: DataFrame) -> float:
    """The last finish time at which the words taken so far keep the budget."""
    queue = queue.where("size > 0").withColumn("copy", F.explode(F.array(*map(F.lit, range(REPEATS))))) \
        .select("size", _finish(F.col("copy")).alias("finish")) \
        .withColumn("bucket", F.least(F.floor(F.col("finish") * PER_UNIT), F.lit(LAST_BUCKET)))
    totals = queue.groupBy("bucket").agg(F.sum("size").alias("words"))
    # each document is queued REPEATS times, so the budget is this share of all that is queued
    budget = F.sum("words").over(Window.partitionBy()) * (SHARE / REPEATS)
    upto = F.sum("words").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    over = totals.select("bucket", (upto - F.col("words")).alias("before"), upto.alias("upto"), budget.alias("budget")) \
        .where("upto > budget").orderBy("bucket").first()
    if over is None:
        return float("inf")
    edge = queue.where(F.col("bucket") == over["bucket"]).groupBy("finish").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.orderBy("finish").rowsBetween(Window.unboundedPreceding, 0))
    fits = edge.select("finish", (running + over["before"]).alias("upto")).where(F.col("upto") <= over["budget"])
    below = queue.where(F.col("bucket") < over["bucket"])
    last = fits.select("finish").unionByName(below.select("finish")).agg(F.max("finish")).first()[0]
    return -1.0 if last is None else last


def plan(docs: DataFrame, stage: Stage) -> DataFrame:
    """(doc_id, source, size, key, i1, i2, source_size, target, upto, copies, taken):
    for every row how often the mix takes it, and the words that makes."""
    queue = stage.write(queued(stage.write(sizes(docs))))
    last = cut(queue)
    copies = sum(F.coalesce((_finish(k) <= F.lit(last)).cast("int"), F.lit(0)) for k in range(REPEATS))
    return queue.withColumn("copies", F.when(F.col("size") > 0, copies).otherwise(F.lit(0))) \
        .withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as it is taken, range-sorted
    by finish time."""
    # rows of one identity are neighbours in the queue: of n, the first c0 are taken, the first c1 of them twice
    per = plan(docs, Stage(docs.sparkSession, "mix")).where("size > 0").groupBy("i1", "i2").agg(
        F.min("upto").alias("first"), *(F.min(c).alias(c) for c in ("size", "source_size", "target")),
        *(F.count_if(F.col("copies") > k).alias(f"c{k}") for k in range(REPEATS))).where("c0 > 0")
    plain = [f.name for f in docs.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    rows = hidden(docs, *identity(), F.col("doc_id").cast("long").alias("doc_id"),
                  F.xxhash64(*(F.col("`" + c.replace("`", "``") + "`") for c in plain)).alias("row"))
    taken = rows.join(per, ["i1", "i2"]).withColumn(
        "number", F.row_number().over(Window.partitionBy("i1", "i2").orderBy("row")) - 1)
    taken = taken.withColumn("upto", F.col("first") + F.col("number") * F.col("size")).select("*", F.explode(F.array_compact(
        F.array(*(F.when(F.col("number") < F.col(f"c{k}"), _finish(k)) for k in range(REPEATS))))).alias("finish"))
    return shown(taken.repartitionByRange("finish", "doc_id").sortWithinPartitions("finish", "doc_id"), docs)
