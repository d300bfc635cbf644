"""Operator 9: byte-level BPE encoding and decoding.

A text is split by the tokenizer's pattern; each distinct piece is encoded
once by folding ranked merges over its bytes; decoding concatenates the ids'
byte strings. The ranks are one fixed table (some 50,000 entries, checked),
sent to the executors as a broadcast value.

The fold runs in numpy over all new pieces of a batch at once: a table holds
the rank of every pair of ids whose joined bytes have a rank; each round merges,
in every piece that still has such a pair, the leftmost pair of least rank,
and finished pieces leave. That is the order of the tiktoken library. Pieces of
over ``LONG`` bytes go through the same merges with a heap instead, so that one
long run of characters costs n log n. A task keeps what it has encoded, up to
``KEPT`` pieces, then starts anew; that bounds memory and changes no result.

Why not Spark's higher-order functions: see the README (estimates, not measured).

A null text is an empty one: no ids, no bytes. Lone surrogates cannot occur in
Spark strings. Every row gets its row; more columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LONG = 128
KEPT = 200_000
#: Characters of text split and encoded at a time.
SLICE = 1 << 20
MOST_RANKS = 500_000

_NONE = np.int32(2**31 - 1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if len(ranks) > MOST_RANKS:
        raise ValueError(f"{path} has {len(ranks)} ranks; at most {MOST_RANKS} are broadcast")
    return ranks


class Merges:
    """Folds ranked merges over the bytes of pieces."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        keys, found = [], []
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    keys.append(left << 32 | right)
                    found.append(rank)
        self.bits = max(8, (2 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.found = np.full(1 << self.bits, _NONE, dtype=np.int32)
        rest, values = np.array(keys, dtype=np.int64), np.array(found, dtype=np.int32)
        slots, self.probes = self._slot(rest), 0
        while len(rest):  # linear probing, all keys a step at a time
            free = np.flatnonzero(self.keys[slots] == -1)
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]], self.found[slots[put]] = rest[put], values[put]
            stay = np.ones(len(rest), dtype=bool)
            stay[put] = False
            rest, values, slots = rest[stay], values[stay], (slots[stay] + 1) & ((1 << self.bits) - 1)
            self.probes += 1
        #: of each known piece: its ids, the same in decimal, and what they decode to
        self.known: dict[str, tuple[tuple[int, ...], str, bytes]] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slots = self._slot(keys)
        at = self.keys[slots]
        out = np.where(at == keys, self.found[slots], _NONE)
        open_ = np.flatnonzero((at != keys) & (at != -1))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            at = self.keys[slots[open_]]
            hit = at == keys[open_]
            out[open_[hit]] = self.found[slots[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
        return out

    def fold(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece (none is empty)."""
        ids = self.byte[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        size = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        done: list[tuple[int, ...]] = [()] * len(pieces)
        live = np.arange(len(pieces))
        while len(live):
            end = np.cumsum(size)
            start = end - size
            rank = np.full(len(ids), _NONE, dtype=np.int32)
            rank[:-1] = self._rank(ids[:-1], ids[1:])
            rank[end - 1] = _NONE  # no pair goes over a piece's end
            least = np.minimum.reduceat(rank, start)
            open_ = least != _NONE
            for k in np.flatnonzero(~open_):
                done[live[k]] = tuple(ids[start[k]:end[k]].tolist())
            if not open_.any():
                break
            best = np.flatnonzero((rank == np.repeat(least, size)) & (rank != _NONE))
            piece = np.searchsorted(end, best, side="right")
            first = np.ones(len(best), dtype=bool)
            first[1:] = piece[1:] != piece[:-1]
            best = best[first]
            ids[best] = rank[best]
            keep = np.repeat(open_, size)
            keep[best + 1] = False
            ids, size, live = ids[keep], size[open_] - 1, live[open_]
        return done

    def fold_long(self, piece: bytes) -> tuple[int, ...]:
        """The same merges, by a heap over a linked list."""
        token = [piece[i:i + 1] for i in range(len(piece))]
        after, before = list(range(1, len(piece) + 1)), list(range(-1, len(piece) - 1))
        heap = []

        def offer(i):
            j = after[i]
            if j < len(piece) and (r := self.ranks.get(token[i] + token[j])) is not None:
                heapq.heappush(heap, (r, i, token[i], token[j]))

        for i in range(len(piece) - 1):
            offer(i)
        while heap:
            _, i, left, right = heapq.heappop(heap)
            j = after[i] if token[i] is not None else len(piece)
            if j >= len(piece) or token[i] != left or token[j] != right:
                continue
            token[i], token[j], after[i] = left + right, None, after[j]
            if after[i] < len(piece):
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return tuple(self.ranks[t] for t in token if t is not None)

    def learn(self, pieces: set[str]) -> None:
        """Encode the pieces that are not known yet."""
        if len(self.known) > KEPT:
            self.known = {}
        short, texts = [], []
        for piece in pieces:
            if piece not in self.known:
                raw = piece.encode()
                if (whole := self.ranks.get(raw)) is not None:
                    self._keep(piece, (whole,))
                elif len(raw) > LONG:
                    self._keep(piece, self.fold_long(raw))
                else:
                    short.append(raw)
                    texts.append(piece)
        if short:
            for piece, ids in zip(texts, self.fold(short)):
                self._keep(piece, ids)

    def _keep(self, piece: str, ids: tuple[int, ...]) -> None:
        self.known[piece] = ids, ",".join(map(str, ids)), b"".join(map(self.token.__getitem__, ids))


def _encoded(texts: pa.Array, merges: Merges, split):
    """What is known of each text's pieces, a list for each run of texts."""
    held, n = [], 0

    def run():
        merges.learn(set(chain.from_iterable(held)))
        return [list(map(merges.known.__getitem__, pieces)) for pieces in held]

    for text in texts:
        text = text.as_py() or ""
        held.append(split(text))
        n += len(text)
        if n >= SLICE:
            yield run()
            held, n = [], 0
    if held:
        yield run()


def _mapped(df: DataFrame, spark: SparkSession, ranks: dict[bytes, int], pattern: str, schema: str, row, names):
    """``row(what is known of the pieces)`` of each text -> columns ``names`` after the id."""
    table = spark.sparkContext.broadcast(ranks)
    kinds = [pa.list_(pa.int32()) if name == "ids" else pa.int64() if name == "n_tokens" else pa.string()
             for name in names]

    def run(batches):
        merges, split = Merges(table.value), regex.compile(pattern).findall
        for batch in batches:
            at = 0
            for found in _encoded(batch.column(1), merges, split):
                out = list(zip(*map(row, found)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(found)), *(pa.array(x, kind) for x, kind in zip(out, kinds))],
                    ["doc_id", *names])
                at += len(found)

    return df.mapInArrow(run, schema)


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, ids): the token ids of each row's text."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _mapped(docs, docs.sparkSession, ranks, pattern, "doc_id long, ids array<int>",
                   lambda pieces: (list(chain.from_iterable(p[0] for p in pieces)),), ["ids"])


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, bytes): the bytes that each row's ids stand for."""
    table = encoded.sparkSession.sparkContext.broadcast({r: t for t, r in ranks.items()})

    def run(batches):
        for batch in batches:
            texts = [b"".join(map(table.value.__getitem__, ids or ())) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.binary())], ["doc_id", "bytes"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def _digests(pieces: list[tuple[tuple[int, ...], str, bytes]]):
    decimal = ",".join([p[1] for p in pieces])
    return (decimal.count(",") + 1 if pieces else 0, hashlib.sha256(decimal.encode()).hexdigest(),
            hashlib.sha256(b"".join([p[2] for p in pieces])).hexdigest())


def token_digests(docs: DataFrame, ranks: dict[bytes, int], pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of what
    ``encode`` and ``decode`` give, without moving the ids themselves."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return _mapped(docs, docs.sparkSession, ranks, pattern,
                   "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
                   _digests, ["n_tokens", "ids_sha256", "decoded_sha256"])
