"""Operator 13 against plain integer products of all rows."""

import math

import numpy as np
import pytest

from quarry.llm import hard_negatives
from quarry.llm.queries import ORACLE, REGISTRY


def plain(rows, every=100, k=5):
    """rows: (vec_id, label, vector), as they are given."""
    known = {(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(math.floor(256.0 * float(c)) for c in v))
             for i, lab, v in rows if i is not None and lab is not None and v is not None
             and all(c is not None and math.isfinite(c) for c in v)}
    anchors, out = {}, []
    for i, lab, v in sorted(known, key=lambda r: (r[0], r[1], len(r[2]), r[2])):
        if i % every == 0:
            anchors.setdefault(i, (lab, v))
    for a, (lab, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, own) for i, own, w in known if i != a and len(w) == len(v))
        for s, p, _ in [r for r in scored if r[2] == lab][:k]:
            near = [r for r in scored if r[2] != lab and 80 * -s <= 100 * -r[0] <= 100 * -s][:k]
            out += [(a, p, n + 1, i, -s, -t) for n, (t, i, _) in enumerate(near)]
    return sorted(out)


def mined(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<double>, score string")
    return sorted(map(tuple, hard_negatives.hard_negatives(table.repartition(3), **options).collect()))


@pytest.mark.parametrize("width, size", [(1, 1.0), (8, 0.3), (13, 5.0), (64, 1000.0)])
def test_tables_and_planes_give_exact_products(width, size):
    rng = np.random.default_rng(width)
    values = np.floor(256 * rng.normal(0, size, (300, width))).astype(np.int64)
    anchors = np.floor(256 * rng.normal(0, size, (7, width))).astype(np.int64)
    found = hard_negatives.scores(hard_negatives.subset_sums(anchors), hard_negatives.pack(values))
    assert (found == values @ anchors.T).all()
    assert not hard_negatives.scores(hard_negatives.subset_sums(anchors * 0), hard_negatives.pack(values)).any()


def test_against_plain_products(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 150)  # several blocks
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = np.random.default_rng(2)
    x = np.abs(rng.normal(size=(900, 11))).round(2)  # positive scores, many of them equal
    x[::3] = x[0]  # a third of all rows hold one vector
    rows = [(int(i), int(rng.integers(0, 10)), v.tolist()) for i, v in enumerate(x)]
    rows += [(-300, 4, x[5].tolist()), (-7, 4, x[0].tolist()), (10_000, 1, [0.0] * 11), (10_100, 1, (-x[1]).tolist())]
    assert mined(spark, rows) == plain(rows)
    assert mined(spark, rows, every=50, k=3) == plain(rows, 50, 3)


def test_hard_cases(spark):
    one = [0.5, 0.25]
    rows = [(0, 1, one), (100, 1, one), (200, 2, [0.5, 0.2]), (3, 2, one), (4, 2, [0.5, 0.249]), (5, None, one), (6, 1, None),
            (8, 1, [None, 0.1]), (9, 2, [float("nan"), 1.0]), (10, 2, [float("inf"), 1.0]), (None, 2, one), (300, 3, [1.0]),
            (11, 3, [0.9]), (12, 4, [0.9]), (400, 5, []), (13, 5, []), (15, 6, []), (200, 2, [0.5, 0.1])]
    assert mined(spark, rows + rows) == plain(rows) != []
    assert mined(spark, rows[:1]) == [] == mined(spark, [])
    big = [(i, i % 2, [2.0**10 * (i + 1), -1e-9, 3.0]) for i in range(100, 106)] + [(300, 1, [2.0**10, 1.0, 1.0])]
    assert mined(spark, big) == plain(big)


def test_query_against_plain_products(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", "embedding").collect()]
    found = REGISTRY["op13_hard_negatives"](spark, sf)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, found.collect())) == plain(rows) != []
    assert "op13_hard_negatives" in ORACLE


def test_anchors_meet_blocks_without_a_broadcast(spark, monkeypatch):
    """Blocks of anchors are few and large: Spark takes them for small ones, and
    one copy for each packed block filled the driver's memory."""
    monkeypatch.setattr(hard_negatives, "BLOCK", 40)
    monkeypatch.setattr(hard_negatives, "ANCHORS", 3)
    rng = np.random.default_rng(6)
    rows = [(i, i % 4, np.abs(rng.normal(size=6 if i % 5 else 3)).round(2).tolist()) for i in range(400)]
    found = hard_negatives.hard_negatives(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"), every=20, k=3)
    assert sorted(map(tuple, found.collect())) == plain(rows, 20, 3) != []
    plan = found._jdf.queryExecution().executedPlan().toString()  # after the run: as it ran
    assert "Broadcast" not in plan and "Generate" not in plan
