"""Operator 8: toxicity from averaged subword embeddings and a linear softmax.

A text is lower-cased (A-Z) and everything in ASCII but letters and digits
separates words. Its subwords are its words and their byte n-grams with one
separator on either side, n = 3 to 6, hashed into ``2**BITS`` buckets. The
embeddings of all subwords are averaged and a softmax over two classes is
linear in that average. Both layers are learned jointly by Adam in numpy, so a
misspelling that was never seen scores by the n-grams it shares. Only buckets
whose use differs between the labels beyond chance are trained; the many others
would only learn the sample by heart.

Training reads a bounded sample of the labelled rows (``SAMPLE`` per label, by
hash of doc_id; the class shares of all labelled rows are then put back into the
bias) and runs in one task. Scoring is a narrow map over whole texts: with a
linear output layer each bucket contributes one number, so the model that is
broadcast is ``2**BITS`` floats and a bias, whatever the input's size.

A null or empty text has no subwords and scores by the bias. Rows whose doc_id
is null can have no label and count as held out. Repeated rows each get their
row; labels that repeat doc_id and value are sampled once, and count in the class
shares as often as they are there; null labels are ignored.
Without labelled rows every score is 0. More columns are ignored: labels, lang,
source and doc_id are never inputs of a score.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.columns import hidden, shown
from quarry.llm.shingles import powers

SIZES = (3, 4, 5, 6)
BITS = 18
DIM = 8
SAMPLE = 2500
EPOCHS = 60
RATE = 0.1
#: Buckets that differ between the labels by fewer standard errors keep weight 0.
CERTAIN = 5.0
#: Averages over a whole text are small; this keeps the steps of Adam in range.
GAIN = 100.0
#: Weightless subwords added to every average, so that a few words decide little.
CALM = 200
SLICE = 1 << 20
#: Rows whose texts are Python strings at a time.
PART = 1000

_SYMBOL = np.full(256, 32, dtype=np.uint64)
_SYMBOL[128:] = np.arange(128, 256)
for _a, _b in ((48, 58), (97, 123)):
    _SYMBOL[_a:_b] = np.arange(_a, _b)
_SYMBOL[65:91] = np.arange(97, 123)
_STEP = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(max(SIZES))]


def _bucket(total: np.ndarray) -> np.ndarray:
    return ((total ^ (total >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int32)


def subwords(data: np.ndarray):
    """For words, then for each size of n-grams: their places and buckets."""
    symbols = _SYMBOL[data]
    gap = symbols == 32
    gaps = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(gap, out=gaps[1:])
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    edge = edge[:len(edge) // 2 * 2] if len(data) and gap[0] else edge[1:1 + (len(edge) - 1) // 2 * 2]
    up, down = powers(len(data))
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(symbols * up[:len(data)], out=run[1:])
    yield edge[::2], _bucket((run[edge[1::2]] - run[edge[::2]]) * down[edge[::2]] + np.uint64(1))
    total = symbols[:len(data)] * _STEP[0]
    for k in range(1, max(SIZES)):
        n = k + 1
        if len(data) < n:
            return
        total = total[:len(data) - k] + symbols[k:] * _STEP[k]
        if n in SIZES:
            # nothing but a separator at either end, and not two of them around nothing
            inner = gaps[n - 1:len(data)] - gaps[1:len(data) - n + 2]
            place = np.flatnonzero(inner == 0)
            yield place, _bucket(total[place])


def _runs(texts):
    """(texts' indices, bytes, start of each text) of about ``SLICE`` bytes; a
    longer text comes in overlapping runs, of which only n-grams that start
    before ``upto`` count."""
    held, size, first = [], 0, 0
    for i, text in enumerate(texts):
        raw = b" " + (text or "").encode() + b" "
        if size and size + len(raw) > SLICE:
            yield _joined(first, held)
            held, size, first = [], 0, i
        if len(raw) > SLICE:
            data = np.frombuffer(raw, dtype=np.uint8)
            for at in range(0, len(data), SLICE):
                yield i, np.array([0]), data[at:at + SLICE + max(SIZES) - 1], SLICE
            first = i + 1
            continue
        held.append(raw)
        size += len(raw)
    if held:
        yield _joined(first, held)


def _joined(first, held):
    starts = np.cumsum([0, *map(len, held[:-1])])
    data = np.frombuffer(b"".join(held), dtype=np.uint8)
    return first, starts, data, len(data)


def logits(texts: list, weight: np.ndarray, bias: float) -> np.ndarray:
    """bias plus the mean weight of each text's subwords."""
    total, count = np.zeros(len(texts)), np.zeros(len(texts))
    for first, starts, data, upto in _runs(texts):
        for place, bucket in subwords(data):
            used = np.searchsorted(place, upto)
            text = np.searchsorted(starts, place[:used], side="right") - 1
            total[first:first + len(starts)] += np.bincount(text, weight[bucket[:used]], len(starts))
            count[first:first + len(starts)] += np.bincount(text, minlength=len(starts))
    return bias + total / (CALM + count)


def fit(texts: list, labels: np.ndarray, dim: int = DIM, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Embeddings and output layer, learned jointly; returned as one weight per
    bucket (embedding times the difference of the two output columns) and a bias."""
    def bags():
        """Buckets of each text, each once, and their shares of its average."""
        for text in texts:
            found = [b[:np.searchsorted(p, upto)] for _, _, data, upto in _runs([text]) for p, b in subwords(data)]
            found, times = np.unique(np.concatenate(found) if found else np.zeros(0, np.int32), return_counts=True)
            yield found.astype(np.int32), times * (GAIN / (CALM + times.sum()))

    # the texts are read twice, so that only the few buckets that are trained are ever held
    target = np.asarray(labels, dtype=np.float64)
    n, share = len(texts), target.mean()
    pull, error = np.zeros(1 << BITS), np.zeros(1 << BITS)
    for (found, value), label in zip(bags(), target):
        pull[found] += value * (label - share)
        error[found] += value * value
    kept = np.flatnonzero(np.abs(pull) > CERTAIN * np.sqrt(error * share * (1 - share)))
    place = np.full(1 << BITS, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept))
    rows, buckets, values = [], [], []
    for i, (found, value) in enumerate(bags()):
        used = place[found] >= 0
        rows.append(np.full(used.sum(), i, dtype=np.int32))
        buckets.append(place[found[used]])
        values.append(value[used])
    row, bucket, value = map(np.concatenate, (rows, buckets, values))
    rng = np.random.default_rng(8)
    params = [rng.normal(0, 0.1, (len(kept), dim)), rng.normal(0, 0.5, (dim, 2)), np.zeros(2)]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, epochs + 1):
        table, out, bias = params
        side = out[:, 1] - out[:, 0]
        logit = np.bincount(row, value * (table @ side)[bucket], n) + (bias[1] - bias[0])
        error = (1 / (1 + np.exp(-np.clip(logit, -50, 50))) - target) / n
        # gradients: of the embeddings (X' error) times the output's difference, of the output embeddings' (X' error)
        pull = np.bincount(bucket, value * error[row], len(kept))
        back = table.T @ pull
        grads = [np.outer(pull, side), np.stack([-back, back], axis=1), np.array([-error.sum(), error.sum()])]
        rate = RATE * (1 - (step - 1) / epochs)
        for p, g, m, v in zip(params, grads, means, squares):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    table, out, bias = params
    weight = np.zeros(1 << BITS, dtype=np.float32)
    weight[kept] = table @ (out[:, 1] - out[:, 0]) * GAIN
    return weight, float(bias[1] - bias[0])


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float] | None:
    """The model of a bounded sample of labelled rows that are not held out."""
    labelled = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")) \
        .where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id", "toxic").count()
    counts = {r["toxic"]: r for r in labelled.groupBy("toxic").agg(F.sum("count").alias("rows"), F.count("*").alias("ids")).collect()}
    if not counts:
        return None
    # ids below a cut of the hash, some more than SAMPLE for each label, are all that is ever ranked
    rank = F.xxhash64("doc_id")
    below = F.lit(False)
    for toxic, r in counts.items():
        share = min(1.0, (SAMPLE + 10 * SAMPLE**0.5) / r["ids"])
        below = below | ((F.col("toxic") == toxic) & (rank <= min(2**63 - 1, int(-2**63 + share * 2**64))))
    order = Window.partitionBy("toxic").orderBy(rank, "doc_id")
    sample = labelled.where(below).withColumn("k", F.row_number().over(order)).where(F.col("k") <= SAMPLE).drop("k", "count")
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")) \
        .join(F.broadcast(sample), "doc_id").select("doc_id", "text", "toxic", F.lit(0).alias("one"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.fillna({"text": ""}).sort_values(["doc_id", "toxic", "text"])
        weight, bias = fit(frame["text"].tolist(), frame["toxic"].to_numpy())
        in_sample = np.clip(frame["toxic"].mean(), 0.01, 0.99)
        return pd.DataFrame({"model": [pickle.dumps((weight, bias, float(in_sample)))]})

    # at most 2 * SAMPLE rows
    model = rows.groupBy("one").applyInPandas(run, "model binary").first()
    if model is None:
        return None
    weight, bias, in_sample = pickle.loads(bytes(model["model"]))
    toxic = sum(r["rows"] for label, r in counts.items() if label == 1)
    share = np.clip(toxic / sum(r["rows"] for r in counts.values()), 0.01, 0.99)
    return weight, bias + float(np.log(share / (1 - share)) - np.log(in_sample / (1 - in_sample)))


def _probabilities(texts: pa.Array, model) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    return 1 / (1 + np.exp(-np.clip(logits(texts.to_pylist(), *model), -50, 50)))


def score(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """``docs`` with a column ``score`` (the last, whatever its columns)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias("score")).schema

    def run(batches):
        for batch in batches:
            scores = _probabilities(batch.column(batch.schema.get_field_index("text")), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())],
                                             [*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = train(docs, labels)
    found = score(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of ``docs`` that score below 0.5, with the columns of ``docs``. A task
    sends each row once and passes on the rows it keeps, a part of a batch at a time."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    rows = hidden(docs)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for first in range(0, max(1, len(batch)), PART):
                part = batch.slice(first, PART)
                kept = _probabilities(part.column(at).cast(pa.string()), sent.value) < 0.5
                yield part.filter(pa.array(kept))

    return shown(rows.mapInArrow(run, rows.schema), docs)
