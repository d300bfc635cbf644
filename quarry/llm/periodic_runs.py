"""Operator 12: periodic runs of words, found by multi-scale minimizers.

A run is a stretch of words with smallest period q (words q apart are equal), of
``max(12, 2 q)`` words or more, that no neighbouring word extends. Documents are
numbered word by word and laid end to end with a mark of its own after each one,
so that numpy works on many documents at once and no run crosses a border.

* **Short periods** (below ``SHORT``): one scan per lag compares the sequence with
  itself; long enough stretches of equal words are the runs of that lag.
* **Longer periods**, scale by scale (P <= q < 2 P, doubling): k-grams of
  k = P/2 words are hashed; a k-gram that holds the least hash of some window of
  P/2 k-grams is a minimizer. A run of period q holds a whole window and its copy
  q words later, so the minimizers of both are equal k-grams q apart. Pairs of
  equal minimizers P to 2 P apart seed a comparison that is extended to either
  side as far as words agree.
* **K-grams inside a run of period up to k/4** would be minimizers over and over.
  They are left out: their runs are known from the scales before. Any other
  k-gram recurs at most a few times within 2 P words. A longer run whose windows
  are all of that kind lies in two adjoining short-period runs of one root; its
  lag is one of those that carry the first run's words onto the second's, and
  those lags seed as well.
* Stretches with the same ends have several lags (multiples of the period); the
  smallest one is the period.

Runs are maximal, so their number is below that of words; the work is
n log n for ordinary text, plus the lengths of the repeats that seeds meet.
Equal words are equal numbers (a dictionary per piece of work), so nothing rests
on hashes but the choice of seeds, and equal k-grams always have equal hashes.

Spark deals rows to tasks as the scan does; nothing is shuffled. A task holds
about ``SLICE`` bytes of text at a time, or one longer text.

A null or empty text has no words and no runs. A null doc_id is never edited.
Repeated rows each get their row. More columns are ignored, whatever their names.
An empty table gives an empty table.
"""

from __future__ import annotations

import collections
import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.shingles import mix

LEAST = 12
#: Periods below this are found by direct scans; a power of two, 4 * LEAST / 3 at least.
SHORT = 32
SLICE = 1 << 20

_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_EMPTY = np.zeros((0, 3), dtype=np.int64)

SCHEMA = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def _stretches(same: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of True of ``least`` places or more."""
    edges = np.flatnonzero(same[1:] != same[:-1]) + 1
    edges = np.concatenate([[0] if same[0] else [], edges, [len(same)] if same[-1] else []]).astype(np.int64)
    first, last = edges[::2], edges[1::2]
    long = last - first >= least
    return first[long], last[long]


def _short_runs(x: np.ndarray, most: int) -> np.ndarray:
    """Rows (start, end, lag) of all lags below ``most``."""
    found = [_EMPTY]
    for lag in range(1, min(most, len(x))):
        first, last = _stretches(x[:-lag] == x[lag:], max(LEAST - lag, lag))
        if len(first):
            found.append(np.stack([first, last + lag, np.full(len(first), lag)], axis=1))
    return np.concatenate(found)


def _primitive(runs: np.ndarray) -> np.ndarray:
    """One row for each (start, end), the one with the smallest lag."""
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), dtype=bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    return runs[new]


def _slide(values: np.ndarray, width: int, best: np.ufunc, pad) -> np.ndarray:
    """best over values[i : i + width] for each i (a shorter window at the end)."""
    n = len(values)
    blocks = -(-n // width) + 1
    padded = np.full(blocks * width, pad, dtype=values.dtype)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = best.accumulate(grid, axis=1).ravel()
    behind = best.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(behind[:n], ahead[width - 1:width - 1 + n])


def _minimizers(values: np.ndarray, width: int) -> np.ndarray:
    """Places that hold the least value of a window of ``width`` places (ties: all of them)."""
    least = _slide(values, width, np.minimum, _NONE)
    # the largest of the minima of the windows that hold a place
    least = np.concatenate([np.zeros(width - 1, dtype=np.uint64), least])
    most = _slide(least, width, np.maximum, np.uint64(0))[:len(values)]
    return np.flatnonzero((most == values) & (values != _NONE))


def _grams(x: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-grams at every place, by doubling (k a power of two)."""
    h = mix(x.astype(np.uint64) + _STEP)
    size = 1
    while size < k:
        h = mix(h[:len(h) - size] * _STEP + h[size:])
        size *= 2
    return h


def _extend(x: np.ndarray, lag: int, first: int, last: int) -> tuple[int, int]:
    """The widest stretch around first..last in which x[i] == x[i + lag]."""
    size, end = 32, len(x) - lag
    while last < end:
        to = min(end, last + size)
        differ = x[last:to] != x[last + lag:to + lag]
        k = int(differ.argmax())
        if differ[k]:
            last += k
            break
        last, size = to, size * 2
    size = 32
    while first > 0:
        to = max(0, first - size)
        differ = (x[to:first] != x[to + lag:first + lag])[::-1]
        k = int(differ.argmax())
        if differ[k]:
            first -= k
            break
        first, size = to, size * 2
    return first, last


def _pair_seeds(x: np.ndarray, doc: np.ndarray, runs: np.ndarray, scale: int) -> np.ndarray:
    """Rows (lag, place, place after the last equal word) from equal minimizers."""
    k = scale // 2
    h = _grams(x, k)
    whole = doc[:len(h)] == doc[k - 1:k - 1 + len(h)]
    calm = runs[(runs[:, 2] <= k // 4) & (runs[:, 1] - runs[:, 0] >= k)]
    inside = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(inside, calm[:, 0], 1)
    np.add.at(inside, calm[:, 1] - k + 1, -1)
    h = np.where(whole & (np.cumsum(inside)[:-1] == 0), h, _NONE)
    place = _minimizers(h, k)
    place = place[np.argsort(h[place], kind="stable")]
    own, at, found, step = h[place], doc[place], [_EMPTY], 1
    while step < len(place):
        gap = place[step:] - place[:-step]
        near = (own[step:] == own[:-step]) & (at[step:] == at[:-step]) & (gap < 2 * scale)
        if not near.any():
            break
        take = np.flatnonzero(near & (gap >= scale))
        first = place[:-step][take]
        found.append(np.stack([gap[take], first, first + k], axis=1))
        step += 1
    seeds = np.concatenate(found)
    if not len(seeds):
        return seeds
    # hashes choose, words decide
    fine = np.ones(len(seeds), dtype=bool)
    for j in range(k):
        fine &= x[seeds[:, 1] + j] == x[seeds[:, 1] + seeds[:, 0] + j]
    return seeds[fine]


def _adjoining_seeds(x: np.ndarray, runs: np.ndarray, scale: int) -> np.ndarray:
    """The like, from short-period runs of one root that adjoin or overlap."""
    calm = runs[(runs[:, 2] <= scale // 8) & (runs[:, 1] - runs[:, 0] >= scale)]
    calm = calm[np.lexsort((calm[:, 0], calm[:, 2]))]
    out = [_EMPTY]
    for (a0, a1, p), (b0, b1, q) in zip(calm[:-1].tolist(), calm[1:].tolist()):
        if p != q or not a0 < b0 <= a1:
            continue
        turn = [d for d in range(p) if np.array_equal(x[a0:a0 + p], x[b0 + d:b0 + d + p])]
        for d in turn:  # one at most: the root is primitive
            lag = b0 + d - a0
            lags = np.arange(scale + (lag - scale) % p, min(2 * scale - 1, a1 - a0, b1 - b0) + 1, p)
            first, last = np.maximum(a0, b0 - lags), np.minimum(a1, b1 - lags)
            out.append(np.stack([lags, first, last], axis=1)[last > first])
    return np.concatenate(out)


def _long_runs(x: np.ndarray, doc: np.ndarray, runs: np.ndarray, scale: int) -> np.ndarray:
    """Rows (start, end, lag) of the lags from ``scale`` to below twice that."""
    seeds = np.concatenate([_pair_seeds(x, doc, runs, scale), _adjoining_seeds(x, runs, scale)])
    found, done, upto = [], -1, -1
    for lag, first, last in seeds[np.lexsort((seeds[:, 1], seeds[:, 0]))].tolist():
        if lag == done and first < upto:
            continue  # inside the stretch just found
        first, last = _extend(x, lag, first, last)
        done, upto = lag, last
        if last - first >= lag:
            found.append((first, last + lag, lag))
    return np.array(found, dtype=np.int64).reshape(-1, 3)


def find_runs(x: np.ndarray, doc: np.ndarray, short: int = SHORT) -> np.ndarray:
    """Rows (start, end, period) of all runs of ``x``, sorted; ``doc`` numbers
    the documents, each of which ends in a number that occurs nowhere else."""
    if not len(x):
        return _EMPTY
    runs = _primitive(_short_runs(x, short))
    places, scale = np.arange(len(x)), short
    while True:
        # only documents with two periods of this scale go on
        _, own, size = np.unique(doc, return_inverse=True, return_counts=True)
        wide = size[own] > 2 * scale
        if not wide.any():
            return runs
        x, doc, places = x[wide], doc[wide], places[wide]
        known = runs[np.isin(runs[:, 0], places)]
        known = np.stack([np.searchsorted(places, known[:, 0]), np.searchsorted(places, known[:, 1]), known[:, 2]], axis=1)
        more = _long_runs(x, doc, known, scale)
        more[:, 0], more[:, 1] = places[more[:, 0]], places[more[:, 1]]
        runs = _primitive(np.concatenate([runs, more]))
        scale *= 2


def edited(doc_id: int | None, words: list) -> list:
    """The words after the contract's edit of one document in ten."""
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a:a + p]
    return words[:a] + (part * -(-(n - a) // max(1, len(part))))[:n - a]


def _digest(words: list, runs: np.ndarray) -> tuple:
    """A document's row from its words and runs (start, end, period), by start."""
    start, end, period = runs.T
    length = end - start
    text = "".join(f"{a},{b},{c}\n" for a, b, c in zip(start.tolist(), length.tolist(), period.tolist()))
    best = (None,) * 4
    kept = words
    if len(runs):
        k = int(np.lexsort((period, start, -length))[0])
        best = (int(start[k]), int(length[k]), int(period[k]), int(1000 * length[k] // period[k]))
        cover = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(cover, start + period, 1)
        np.add.at(cover, end, -1)
        kept = [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0).tolist()]
    return (len(words), len(runs), *best, hashlib.sha256(text.encode()).hexdigest(),
            hashlib.sha256(b" ".join(kept)).hexdigest())


def _work(docs: list[list], short: int) -> list[tuple]:
    """Rows of a few documents (lists of words)."""
    numbers = collections.defaultdict(itertools.count().__next__)
    x = np.fromiter(map(numbers.__getitem__, itertools.chain.from_iterable(docs)), dtype=np.int64)
    size = np.array([len(words) for words in docs])
    first = np.cumsum(size + 1) - size - 1
    doc = np.repeat(np.arange(len(docs)), size + 1)
    laid = np.empty(len(x) + len(docs), dtype=np.int64)
    mark = np.zeros(len(laid), dtype=bool)
    mark[first + size] = True
    laid[~mark], laid[mark] = x, len(numbers) + np.arange(len(docs))
    runs = find_runs(laid, doc, short)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 0]))]
    bounds = np.searchsorted(runs[:, 0], np.append(first, len(laid)))
    return [_digest(words, runs[a:b] - [[f, f, 0]]) for words, f, a, b in zip(docs, first.tolist(), bounds, bounds[1:])]


def _runs_of(edit: bool, short: int):
    def run(batches):
        for batch in batches:
            ids, held, size, rows = batch.column(0).to_pylist(), [], 0, []
            for doc_id, text in zip(ids, batch.column(1)):
                raw = b"" if (value := text.as_buffer()) is None else value.to_pybytes()
                if held and size + len(raw) > SLICE:
                    rows += _work(held, short)
                    held, size = [], 0
                words = raw.split()  # on \x20 and \x09-\x0D, as bytes do
                held.append(edited(doc_id, words) if edit else words)
                size += len(raw)
            if held:
                rows += _work(held, short)
            columns = zip(*rows) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.string() if i > 5 else pa.int64()) for i, c in enumerate(columns))],
                [f.split()[0] for f in SCHEMA.split(", ")])
    return run


def periodic_runs(docs: DataFrame, edit: bool = False, short: int = SHORT) -> DataFrame:
    """(doc_id, n_words, n_runs, start, length, period, exponent_milli of the
    longest run, runs_sha256, collapsed_sha256) of each row of ``docs`` (doc_id,
    text). ``edit`` applies ``edited`` first; ``short`` is ``SHORT``."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_runs_of(edit, short), SCHEMA)
