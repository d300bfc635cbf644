"""Word and shingle hashes of whole texts, computed with numpy per Arrow batch.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. On UTF-8 bytes the
separators are single bytes that occur in no other character, so the work is
done on the Arrow buffer itself, in slices of at most ``SLICE`` bytes (a longer
text is cut at white space). A word's hash is a polynomial over its bytes,
taken from one running sum; a shingle's hash combines five word hashes. All
are 64 bits wide and mixed, so that hash order is a random order.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
WORDS = 5

_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_WEIGHTS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93,
                     0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.arange(1, 257, dtype=np.uint64)
_BYTE[65:91] += np.uint64(32)
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection on 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _POWERS or len(_POWERS["p"]) < n + 1:
        for name, base in (("p", _BASE), ("q", _BASE_INVERSE)):
            a = np.full(max(n, SLICE) + 1, base, dtype=np.uint64)
            a[0] = 1
            _POWERS[name] = np.cumprod(a, dtype=np.uint64)
    return _POWERS["p"], _POWERS["q"]


def _slice_words(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start places of the words in ``data``; no word crosses a break."""
    space = _SPACE[data]
    before = np.empty(len(data), dtype=bool)
    before[0] = True
    before[1:] = space[:-1]
    before[breaks] = True
    after = np.empty(len(data), dtype=bool)
    after[-1] = True
    after[:-1] = space[1:]
    after[breaks[breaks > 0] - 1] = True
    first = np.flatnonzero(~space & before)
    last = np.flatnonzero(~space & after) + 1
    up, down = powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * up[:len(data)], out=total[1:])
    hashes = (total[last] - total[first]) * down[first]
    return mix(hashes + (last - first).astype(np.uint64) * _WEIGHTS[0]), first


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return offsets, data


def slices(texts: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, start of each row in them):
    runs of rows with at most ``most`` bytes, or one longer row."""
    if not len(texts):
        return
    offsets, data = _buffers(texts.fill_null(""))
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1)
        end = min(end, len(texts))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def words(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, word hashes, row bounds in them) for runs of rows."""
    for row, end, data, starts in slices(texts):
        if len(data) <= SLICE:
            breaks = starts[:-1][starts[:-1] < len(data)]
            hashes, first = _slice_words(data, breaks) if len(data) else (np.zeros(0, np.uint64),) * 2
            yield row, hashes, np.searchsorted(first, starts)
            continue
        parts, at = [], 0  # one long text, cut at white space
        while at < len(data):
            to = min(at + SLICE, len(data))
            if to < len(data):
                inside = np.flatnonzero(_SPACE[data[at:to]])
                if len(inside):
                    to = at + int(inside[-1]) + 1
                else:
                    later = np.flatnonzero(_SPACE[data[to:]])
                    to = to + int(later[0]) + 1 if len(later) else len(data)
            parts.append(_slice_words(data[at:to], np.zeros(1, dtype=np.int64))[0])
            at = to
        hashes = np.concatenate(parts)
        yield row, hashes, np.array([0, len(hashes)])


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's distinct shingle hashes, ascending. A text with fewer than
    five words has its whole sequence as one; one without words has none."""
    for _, hashes, bounds in words(texts):
        if len(hashes) >= WORDS:
            run = hashes[:-4] * _WEIGHTS[0]
            for k in range(1, WORDS):
                run += hashes[k:len(hashes) - 4 + k] * _WEIGHTS[k]
            run = mix(run)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= WORDS:
                yield np.unique(run[a:b - 4])
            elif b > a:
                yield mix((hashes[a:b] * _WEIGHTS[:b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.zeros(0, dtype=np.uint64)
