"""Operator 13: hard negatives by Four-Russians scoring on packed bit planes.

Components become integers, ``floor(256 x)`` in double precision. Rows are dealt
to blocks of about ``BLOCK`` rows. Each block is packed once: eight dimensions
make a group, and a group's bit j over a row's eight components is one byte, so
that a block is a byte array (bit plane, group, row), two's complement, with as
many planes as its largest component needs. Packed blocks go to a table in the
shared folder.

Anchors (rows whose vec_id is divisible by ``every``) meet every packed block in
blocks of ``ANCHORS``: a stated query set against all rows. Blocks of anchors are
written once for each pass; tasks that hold packed blocks read them. Neither side
is broadcast, and anchors are not copied for each packed block. For each anchor and
group, a table of 256 entries holds the sums of the anchor's eight components
over all subsets. A row's byte picks its entry; the entries of a plane are added
over the groups, and planes are shifted and added from the highest down (the sign
plane counts negative). That gives full, exact integer scores.

The first pass scores rows of the anchor's label and keeps each block's best
``k``; a window merges them to the anchor's positives. The second pass scores
rows of other labels and keeps, for each positive, each block's best ``k`` within
``LOW`` to ``HIGH`` percent of the positive's score; a window merges them again.
Scores are never rows: a task returns at most k rows for each anchor and block
(k * k in the second pass). A block is one row, so nothing depends on how labels,
vectors or scores are spread, and an executor that is lost costs only its blocks.

Rows with a null vec_id, label or vector or with a null or non-finite component
take no part. A vector that is empty has scores of 0. Rows meet rows of their own
width only. Rows that repeat vec_id, label and components are one; a vec_id with
several different rows is asked with the least of them, each of the rows can be
found, and "other rows" are those of another vec_id. Scores are 64-bit integers.
An anchor without positives, or a positive without negatives, has no rows; an
empty table gives none. More columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.storage import Stage, every_pair

SCALE = 256
BLOCK = 4096
ANCHORS = 256
#: Rows scored at a time; with ANCHORS it bounds a task's score matrix (2 MB).
STEP = 1024
GROUP = 8
LOW, HIGH = 80, 100

_BITS = (np.arange(1 << GROUP)[:, None] >> np.arange(GROUP) & 1).astype(np.int64)


def integers(table: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(vec_id, label, width, v): the different rows that take part, v as integers."""
    rows = table.select(F.col("vec_id").cast("long"), F.col(label).cast("long").alias("label"),
                        F.col(vector).cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine).select(
        "vec_id", "label", F.size("v").alias("width"),
        F.transform("v", lambda c: F.floor(c * SCALE).cast("long")).alias("v")).distinct()


def pack(values: np.ndarray) -> np.ndarray:
    """Bit planes (plane, group, row) of integers (row, dimension), highest plane
    first; dimensions are filled up with zeros to whole groups."""
    n, width = values.shape
    groups = max(1, -(-width // GROUP))
    filled = np.zeros((n, groups, GROUP), dtype=np.int64)
    filled.reshape(n, -1)[:, :width] = values
    largest = max(int(filled.max(initial=0)), -1 - int(filled.min(initial=0)))
    planes = np.arange(largest.bit_length(), -1, -1)
    return np.stack([np.packbits((filled >> j & 1).astype(np.uint8), axis=2, bitorder="little")[:, :, 0].T for j in planes])


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(group, byte, anchor): sums of each anchor's components over a byte's bits."""
    n, width = anchors.shape
    groups = max(1, -(-width // GROUP))
    filled = np.zeros((n, groups * GROUP), dtype=np.int64)
    filled[:, :width] = anchors
    return np.stack([_BITS @ filled[:, g * GROUP:(g + 1) * GROUP].T for g in range(groups)])


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(row, anchor) exact inner products from tables and bit planes."""
    total = np.zeros((planes.shape[2], sums.shape[2]), dtype=np.int64)
    for j, plane in enumerate(planes):
        own = sums[0].take(plane[0], axis=0)
        for g in range(1, len(sums)):
            own += sums[g].take(plane[g], axis=0)
        total <<= 1
        if j:
            total += own
        else:
            total -= own  # the sign plane
    return total


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    values = column.combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(values), width)


def _pack_block(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by([("vec_id", "ascending")])
    width = rows.column("width")[0].as_py()
    planes = pack(_matrix(rows.column("v"), width))
    return pa.table({"width": pa.array([width], pa.int32()), "block": rows.column("block").combine_chunks()[:1],
                     "n_planes": pa.array([len(planes)], pa.int32()),
                     "ids": pa.array([rows.column("vec_id").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                     "labels": pa.array([rows.column("label").to_numpy().astype(np.int64).tobytes()], pa.binary()),
                     "planes": pa.array([planes.tobytes()], pa.binary())})


def _order(score: np.ndarray) -> np.ndarray:
    """Places from the highest score down; equal ones as they stand (by vec_id)."""
    return np.argsort(-score, kind="stable")


def _best_positives(score, ids, anchor, k):
    """The first k other rows."""
    order = _order(score)[:k + int((ids == anchor["vec_id"]).sum())]
    order = order[ids[order] != anchor["vec_id"]][:k]
    return [(anchor["vec_id"], None, None, int(ids[i]), int(score[i])) for i in order]


def _best_negatives(score, ids, anchor, k):
    """For each positive, the first k other rows within its bounds."""
    fine = ids != anchor["vec_id"]
    score, ids = score[fine], ids[fine]
    order = _order(score)
    falling = -score[order]
    out = []
    for p in anchor["positives"]:
        s = p["score"]
        # LOW * s <= 100 * score <= HIGH * s, in whole numbers
        least, most = -(-LOW * s // 100), HIGH * s // 100
        first, last = np.searchsorted(falling, [-most, -least + 1])
        out += [(anchor["vec_id"], p["vec_id"], s, int(ids[i]), int(score[i])) for i in order[first:min(last, first + k)]]
    return out


def _scored(k: int, same: bool):
    """Rows of (block, anchors) -> the block's best rows for each anchor."""
    best = _best_positives if same else _best_negatives

    def of_label(sums, planes, ids, labels, anchors, numbers):
        rows = np.flatnonzero((labels == anchors[numbers[0]]["label"]) == same)
        own = sums[:, :, numbers]
        parts = [scores(own, planes[:, :, rows[at:at + STEP]]) for at in range(0, len(rows), STEP)]
        if parts:
            found = np.concatenate(parts)
            for i, a in enumerate(numbers):
                yield from best(np.ascontiguousarray(found[:, i]), ids[rows], anchors[a], k)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
                planes = np.frombuffer(row["planes"], np.uint8).reshape(row["n_planes"], -1, len(ids))
                anchors = sorted(row["anchors"], key=lambda a: a["label"])
                values = np.array([a["v"] for a in anchors], dtype=np.int64).reshape(len(anchors), row["width"])
                sums, out, at = subset_sums(values), [], 0
                while at < len(anchors):
                    to = at
                    while to < len(anchors) and anchors[to]["label"] == anchors[at]["label"]:
                        to += 1
                    out += of_label(sums, planes, ids, labels, anchors, np.arange(at, to))
                    at = to
                columns = zip(*out) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns],
                                                 ["anchor_id", "positive_id", "positive_score", "vec_id", "score"])
    return run


def _met(stage: Stage, anchors: DataFrame, packed: DataFrame, blocks: int, anchor_blocks: int, k: int, same: bool) -> DataFrame:
    """The best rows of every pair of an anchor block and a packed block."""
    asked = stage.write(anchors.groupBy("width", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(anchor_blocks)).alias("asked")).agg(
        F.collect_list(F.struct(*(c for c in anchors.columns if c != "width"))).alias("anchors")))  # about ANCHORS
    return every_pair(packed, blocks, "block", asked).select("width", "n_planes", "ids", "labels", "planes", "anchors").mapInArrow(
        _scored(k, same), "anchor_id long, positive_id long, positive_score long, vec_id long, score long")


def mine(rows: DataFrame, every: int = 100, k: int = 5) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score,
    negative_score) from ``integers`` rows."""
    stage = Stage(rows.sparkSession, "negatives")
    rows = stage.write(rows)
    blocks = max(1, -(-rows.count() // BLOCK))
    packed = stage.write(rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(blocks)).cast("int"))
                         .groupBy("width", "block").applyInArrow(
                             _pack_block, "width int, block int, n_planes int, ids binary, labels binary, planes binary"))
    anchors = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(
        F.min(F.struct("label", "width", "v")).alias("a")).select("vec_id", "a.*")
    anchor_blocks = max(1, -(-anchors.count() // ANCHORS))

    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    positives = _met(stage, anchors, packed, blocks, anchor_blocks, k, True) \
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives"))  # k at most
    with_positives = anchors.join(positives.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    best = Window.partitionBy("anchor_id", "positive_id", "positive_score").orderBy(F.desc("score"), "vec_id")
    return _met(stage, with_positives, packed, blocks, anchor_blocks, k, False) \
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                F.col("score").alias("negative_score"))


def hard_negatives(table: DataFrame, every: int = 100, k: int = 5, shifted: int = 7, classes: int = 10) -> DataFrame:
    """``mine`` of a table (vec_id, embedding, label); where vec_id is divisible by
    ``shifted``, the label is the next one of ``classes`` first."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % shifted == 0, (label + 1) % classes).otherwise(label)
    return mine(integers(table.select("vec_id", moved.alias("label"), "embedding")), every, k)
