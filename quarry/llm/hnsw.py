"""Operator 4: approximate nearest neighbours by a small-world graph per shard.

Rows are dealt to shards by a hash of vec_id, about ``SHARD_ROWS`` a shard. Each
shard is one task's work: a hierarchical navigable small-world graph (Malkov and
Yashunin, 2018) over its distinct unit vectors, built in numpy and kept as flat
arrays: vectors, and for each level a table of neighbour numbers, M wide (2 M on
the ground level). Graphs go to a table in the shared folder, one row a shard.

Queries (rows whose vec_id is divisible by the given number) meet every shard in
blocks: blocks are a written table too, a task holds some shards' graphs, reads
blocks and searches one block in one graph, all its queries step by step at once.
Neither side is broadcast, and blocks are not copied for each shard. A shard
returns the best found for each query; these are merged by score, ties to the
smaller vec_id. Scores are cosines of the original vectors in double precision.

Equal vectors of a shard are one node: a hot vector cannot fill its own neighbour
lists, and its ids come back in order, as many as a query can use.

Vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do those of another width than the query's. A null vec_id is never a
query and never found. Rows that repeat vec_id and vector are one candidate; a
vec_id with several vectors is asked with the least of them; a query never finds
its own vec_id. Fewer candidates than k: all of them.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.storage import Stage, every_pair

SHARD_ROWS = 6000
M = 16
BUILD = 64
SEARCH = 128
BLOCK = 512


class Graph:
    """Neighbour arrays over unit vectors."""

    def __init__(self, x: np.ndarray, levels: list[np.ndarray], members: list[np.ndarray]):
        #: levels[l][i] are neighbour numbers in members[l], -1 where there is none
        self.x, self.levels, self.members = x, levels, members

    @staticmethod
    def build(x: np.ndarray, seed: int = 4) -> Graph:
        n = len(x)
        height = (-np.log(np.random.default_rng(seed).random(n)) / np.log(M)).astype(int)
        height[0] = max(height.max(initial=0), 0)  # the entry is on the top level
        top = int(height[0]) if n else 0
        near = [np.full((n, M * (2 if level == 0 else 1)), -1, dtype=np.int32) for level in range(top + 1)]
        sims = [np.full(a.shape, -2.0, dtype=np.float32) for a in near]
        seen = np.zeros(n, dtype=np.int32)
        mark = 0
        for i in range(1, n):
            own = x[:i + 1] @ x[i] if i <= BUILD else None
            at = 0
            best = float(x[0] @ x[i])
            for level in range(top, int(height[i]), -1):  # greedy descent
                while True:
                    nb = near[level][at]
                    nb = nb[nb >= 0]
                    if not len(nb):
                        break
                    s = x[nb] @ x[i]
                    k = int(s.argmax())
                    if s[k] <= best:
                        break
                    at, best = int(nb[k]), float(s[k])
            entry = np.array([at])
            for level in range(min(top, int(height[i])), -1, -1):
                if own is not None:
                    found = np.flatnonzero(height[:i] >= level)
                    score = own[found]
                else:
                    mark += 1
                    found, score = _beam(x, near[level], x[i], entry, BUILD, seen, mark)
                order = np.argsort(-score, kind="stable")[:BUILD]
                found, score = found[order], score[order]
                entry = found
                chosen = _spread(x, found, score, M)
                near[level][i, :len(chosen)] = found[chosen]
                sims[level][i, :len(chosen)] = score[chosen]
                for j, s in zip(found[chosen], score[chosen]):
                    _link(x, near[level], sims[level], int(j), i, float(s))
        members = [np.flatnonzero(height >= level).astype(np.int32) for level in range(top + 1)]
        return Graph(x, [near[level][members[level]] for level in range(top + 1)], members)

    def search(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, scores) of the k best nodes found for each query, best first."""
        n = len(self.x)
        if not n:
            return np.zeros((len(queries), 0), np.int32), np.zeros((len(queries), 0), np.float32)
        near = self.levels[0]
        at = np.zeros(len(queries), dtype=np.int64)
        best = queries @ self.x[0]
        for table, members in zip(self.levels[:0:-1], self.members[:0:-1]):
            place = np.full(n, -1, dtype=np.int64)
            place[members] = np.arange(len(members))
            live = np.arange(len(queries))
            while len(live):  # greedy, all queries a step at a time
                nb = table[place[at[live]]]
                s = np.where(nb >= 0, np.einsum("qmd,qd->qm", self.x[nb], queries[live]), -2.0)
                j = s.argmax(axis=1)
                s, nb = s[np.arange(len(live)), j], nb[np.arange(len(live)), j]
                better = s > best[live]
                live, nb, s = live[better], nb[better], s[better]
                at[live], best[live] = nb, s
        # ground level: the best SEARCH of each query; the best one not yet expanded goes next
        width = max(SEARCH, k)
        ids = np.full((len(queries), width), -1, dtype=np.int64)
        score = np.full((len(queries), width), -3.0, dtype=np.float32)
        done = np.ones((len(queries), width), dtype=bool)
        ids[:, 0], score[:, 0], done[:, 0] = at, best, False
        met = np.zeros((len(queries), n), dtype=bool)
        met[np.arange(len(queries)), at] = True
        live = np.arange(len(queries))
        while len(live):
            j = np.where(done[live], -4.0, score[live]).argmax(axis=1)
            more = ~done[live, j]
            live, j = live[more], j[more]
            if not len(live):
                break
            done[live, j] = True
            nb = near[ids[live, j]]
            new = (nb >= 0) & ~met[live[:, None], nb]
            q, c = np.nonzero(new)
            met[live[q], nb[q, c]] = True
            s = np.full(nb.shape, -3.0, dtype=np.float32)
            s[q, c] = np.einsum("pd,pd->p", self.x[nb[q, c]], queries[live[q]])
            all_s = np.concatenate([score[live], s], axis=1)
            all_i = np.concatenate([ids[live], nb], axis=1)
            all_d = np.concatenate([done[live], ~new], axis=1)
            keep = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
            row = np.arange(len(live))[:, None]
            score[live], ids[live], done[live] = all_s[row, keep], all_i[row, keep], all_d[row, keep]
        order = np.argsort(-score, axis=1, kind="stable")[:, :min(k, n)]
        row = np.arange(len(queries))[:, None]
        return ids[row, order], score[row, order]


def _beam(x, near, q, entry, width, seen, mark):
    """Best-first search on one level for one vector."""
    seen[entry] = mark
    ids, score = entry.astype(np.int64), x[entry] @ q
    open_ = np.ones(len(ids), dtype=bool)
    while True:
        # expand several of the best open ones at once
        todo = np.flatnonzero(open_)
        if not len(todo):
            return ids, score
        todo = todo[np.argsort(-score[todo], kind="stable")[:8]]
        open_[todo] = False
        nb = near[ids[todo]].ravel()
        nb = np.unique(nb[nb >= 0])
        nb = nb[seen[nb] != mark]
        if not len(nb):
            continue
        seen[nb] = mark
        ids = np.concatenate([ids, nb])
        score = np.concatenate([score, x[nb] @ q])
        open_ = np.concatenate([open_, np.ones(len(nb), dtype=bool)])
        if len(ids) > width:
            keep = np.argpartition(-score, width - 1)[:width]
            ids, score, open_ = ids[keep], score[keep], open_[keep]


def _spread(x, found, score, most):
    """Neighbours in different directions: one that is nearer to a chosen one
    than to the vector itself waits; the best waiting ones fill up."""
    if len(found) <= most:
        return np.arange(len(found))
    between = x[found] @ x[found].T
    chosen, open_ = [], np.ones(len(found), dtype=bool)
    for k in range(len(found)):
        if open_[k]:
            chosen.append(k)
            if len(chosen) == most:
                break
            open_ &= between[k] <= score
    rest = [k for k in range(len(found)) if k not in set(chosen)]
    return np.array(sorted(chosen + rest[:most - len(chosen)]))


def _link(x, near, sims, j, i, s):
    """Add i to the neighbours of j; a full list keeps a spread of the best."""
    free = np.flatnonzero(near[j] < 0)
    if len(free):
        near[j, free[0]], sims[j, free[0]] = i, s
        return
    ids, score = np.append(near[j], i), np.append(sims[j], np.float32(s))
    order = np.argsort(-score, kind="stable")
    ids, score = ids[order], score[order]
    chosen = _spread(x, ids, score, near.shape[1])
    near[j], sims[j] = ids[chosen], score[chosen]


def _unit(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision (scaled first, so that squares stay finite)."""
    raw = raw / np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True))


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, width, v): the rows that take part, components in double precision."""
    rows = table.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    fine = F.forall("v", lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)))
    return rows.where(F.col("vec_id").isNotNull() & fine & F.exists("v", lambda c: c != 0)) \
        .select("vec_id", F.size("v").alias("width"), "v")


def _build(kept: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        raw = np.stack(rows["v"].to_list()).astype(np.float64)
        raw, node = np.unique(raw, axis=0, return_inverse=True)
        pairs = np.unique(np.stack([node.ravel(), rows["vec_id"].to_numpy()], axis=1), axis=0)  # repeated rows once
        first = np.searchsorted(pairs[:, 0], np.arange(len(raw) + 1))
        ids = [pairs[a:min(b, a + kept), 1] for a, b in zip(first[:-1], first[1:])]  # ties go to the smallest
        mixed = np.random.default_rng(len(raw)).permutation(len(raw))  # not in sorted order
        raw, ids = raw[mixed], [ids[k] for k in mixed]
        graph = Graph.build(_unit(raw).astype(np.float32))
        return pd.DataFrame({"width": [raw.shape[1]], "shard": [rows["shard"].iloc[0]],
                             "graph": [_packed(raw, ids, graph.levels, graph.members)]})
    return run


def _packed(raw, ids, levels, members) -> bytes:
    """A shard's graph in few bytes, as they are sent with each block: vectors in
    single precision if that is exact, ids in one array, short numbers."""
    with np.errstate(over="ignore"):
        short = raw.astype(np.float32)
    ends = np.cumsum([len(i) for i in ids])
    least = np.int16 if len(raw) <= np.iinfo(np.int16).max else np.int32
    return pickle.dumps((short if (short == raw).all() else raw, np.concatenate(ids), ends,
                         [x.astype(least) for x in levels], [x.astype(least) for x in members]))


def _unpacked(graph) -> tuple:
    """(unit vectors in double precision, ids of each, the graph)."""
    raw, ids, ends, levels, members = pickle.loads(graph)
    unit = _unit(raw.astype(np.float64))
    return unit, np.split(ids, ends[:-1]), Graph(unit.astype(np.float32), [x.astype(np.int32) for x in levels],
                                                 [x.astype(np.int32) for x in members])


def _search(k: int):
    def run(batches):
        last, held = None, None
        for batch in batches:
            graphs, queries = batch.column("graph"), batch.column("queries")
            for i, key in enumerate(zip(batch.column("width").to_pylist(), batch.column("shard").to_pylist())):
                if key != last:
                    last, held = key, _unpacked(graphs[i].as_buffer())
                unit, ids, graph = held
                asking = queries[i].values  # one at a time and without copies: rows are large
                own = _unit(asking.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(asking), key[0]))
                found, _ = graph.search(own.astype(np.float32), k + 1)
                out = []
                for q, v, nodes in zip(asking.field("vec_id").to_pylist(), own, found):
                    score = np.clip((unit[nodes] * v).sum(axis=1), -1.0, 1.0)
                    out += [(q, int(i), float(s)) for node, s in zip(nodes, score) for i in ids[node] if i != q]
                asked, ids_, scores = zip(*out) if out else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(asked, pa.int64()), pa.array(ids_, pa.int64()),
                                                  pa.array(scores, pa.float64())], ["query_id", "vec_id", "score"])
    return run


def nearest(table: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row
    whose vec_id is divisible by ``every``."""
    stage = Stage(table.sparkSession, "hnsw")
    rows = vectors(table)
    shards = max(1, -(-rows.count() // SHARD_ROWS))
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    graphs = stage.write(dealt.groupBy("width", "shard").applyInPandas(
        _build(k + 1), "width int, shard int, graph binary"))
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("width", "v")).alias("q")) \
        .select("vec_id", "q.*")
    blocks = max(1, -(-asked.count() // BLOCK))
    asked = stage.write(asked.groupBy("width", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("vec_id", "v")).alias("queries")))  # about BLOCK of them
    found = every_pair(graphs, shards, "shard", asked).select("width", "shard", "queries", "graph").mapInArrow(
        _search(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
