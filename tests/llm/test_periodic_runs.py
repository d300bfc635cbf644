"""Operator 12 against a scan of every lag, on words made to be awkward."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from quarry.llm import periodic_runs
from quarry.llm.queries import REGISTRY

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_lags(words):
    """(start, end, smallest period) of every run, one lag after the other."""
    x, found = np.array(words), {}
    for q in range(1, len(x) // 2 + 1):
        differ = np.flatnonzero(np.concatenate([[True], x[:-q] != x[q:], [True]])) - 1
        for i, j in zip(differ[:-1].tolist(), differ[1:].tolist()):  # equal from i + 1 to j - 1
            if j - i - 1 + q >= max(12, 2 * q):
                found.setdefault((i + 1, j + q), q)
    return sorted((a, b, q) for (a, b), q in found.items())


def sequence(rng, kind):
    n = rng.randrange(700)
    if kind == "few":
        return [rng.randrange(2) for _ in range(n)]
    if kind == "alternating":  # squares of a word that is itself periodic, but not whole
        return (([0, 1] * rng.randrange(1, 60) + [0] * rng.randrange(2)) * 10)[:n]
    if kind == "fibonacci":
        a, b = [0], [0, 1]
        while len(b) < n:
            a, b = b, b + a
        return b[:n]
    if kind == "stutter":
        root, out = [rng.randrange(3) for _ in range(rng.randrange(1, 8))], []
        while len(out) < n:
            out += root * rng.randrange(1, 40) + [rng.randrange(4) for _ in range(rng.randrange(3))]
        return out[:n]
    if kind == "long":
        root = [rng.randrange(1000) for _ in range(rng.randrange(1, 200))]
        return ([rng.randrange(1000) for _ in range(rng.randrange(50))] + root * 4)[:n]
    if kind == "nested":
        root = [0] * rng.randrange(1, 30) + [1] + [0] * rng.randrange(1, 40)
        return ((root * rng.randrange(1, 6) + [rng.randrange(3)]) * 6)[:n]
    root, out = [0, 1, 2][:rng.randrange(1, 4)], []  # pieces of one root that adjoin
    while len(out) < n:
        out += (root * 60)[rng.randrange(3):][:rng.randrange(8, 45)]
    return out[:n]


@pytest.mark.parametrize("kind", ["few", "alternating", "fibonacci", "stutter", "long", "nested", "adjoining"])
def test_runs_against_all_lags(kind):
    rng = random.Random(kind)
    for _ in range(5):
        docs = [sequence(rng, kind) for _ in range(6)]
        laid = [w for i, words in enumerate(docs) for w in [*words, 10**6 + i]]
        doc = [i for i, words in enumerate(docs) for _ in range(len(words) + 1)]
        runs, first = periodic_runs.find_runs(np.array(laid), np.array(doc)).tolist(), 0
        for i, words in enumerate(docs):
            own = sorted((a - first, b - first, q) for a, b, q in runs if first <= a < first + len(words) + 1)
            assert own == all_lags(words)
            first += len(words) + 1


def row(doc_id, text, edit=True):
    """The contract's row, word by word."""
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if edit and doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    numbers = {}
    runs = sorted((a, b - a, q) for a, b, q in all_lags([numbers.setdefault(w, len(numbers)) for w in words]))
    gone = {i for a, size, q in runs for i in range(a + q, a + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, n, len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4),
            hashlib.sha256("".join(f"{a},{s},{q}\n" for a, s, q in runs).encode()).hexdigest(),
            hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in gone).encode()).hexdigest())


def test_hard_cases(docs, none, spark):
    found = sorted(map(tuple, periodic_runs.periodic_runs(docs, edit=True).collect()), key=str)
    assert found == sorted((row(r.doc_id, r.text) for r in docs.collect()), key=str)
    assert periodic_runs.periodic_runs(none).count() == 0
    long = [(i, t) for i, t in enumerate(["x" * 3_000_000, "a b " * 200_000, "\x0b\x0c\r", "a\x1cb \u2003 c",
                                          "one\u0085two " * 12])]
    found = {r.doc_id: r for r in periodic_runs.periodic_runs(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    assert tuple(found[0])[1:3] == (1, 0) and tuple(found[1])[1:7] == (400_000, 1, 0, 400_000, 2, 200_000_000)
    assert found[2].n_words == 0 and found[3].n_words == 3 and tuple(found[4])[1:6] == (12, 1, 0, 12, 1)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = {r.doc_id: tuple(r) for r in REGISTRY["op12_periodic_runs"](spark, sf).collect()}
    short = [r for r in texts if len(r.text) < 20_000]
    assert len(found) == len(texts) and len(short) > 150
    assert all(found[r.doc_id] == row(r.doc_id, r.text) for r in short)
    assert any(found[r.doc_id][5] and found[r.doc_id][5] >= 64 for r in short)
