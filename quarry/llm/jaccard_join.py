"""Operator 3: n-gram Jaccard join by token-combination prefixes.

Documents link when ``100 * |A & B| >= 80 * |A | B|`` over their sets of
distinct five-word shingles. The join is a prefix filter with combinations
(k-wise signatures, k = 2):

* A token is *frequent* if its slot in a fixed-size count of all tokens stands
  out (``slot_bits``), else *rare*. The global order is rare before frequent,
  then by hash. Any fixed rule gives a valid order; this one keeps shared
  passages out of a prefix as long as a document has text of its own.
* A set of n tokens can miss at most ``n - ceil(0.8 n)`` tokens of a partner.
  Its prefix is extended until the signatures cover one more: a rare token
  covers one by itself, a class of c frequent tokens covers ``c - 1`` by the
  pairs within the class. So two linked sets share a single rare token or a
  pair of frequent ones.
* Classes are ``hash mod G``, with G by the set's size octave, so that pairs
  stay proportional to the prefix; a set near the end of its octave also signs
  for the next one, where a larger partner can be.
* Sets that share a signature are first compared with two centres of each list
  (for pairs, one is the set with the fewest rare tokens, the likely original of
  edited copies): linear work that joins up groups of copies.
  Then every pair in one list whose sets are still in different components is
  counted, with the number c of its shared singles. A prefix of rare tokens only
  bounds the overlap by ``ceil(0.8 n) - 1 + c``. Two prefixes that reach the
  frequent tokens hold all rare tokens of their sets, so that the overlap is at
  most c plus the smaller number of frequent tokens. That drops pairs that share
  only a passage, or edits of one text that went different ways. The rest are
  verified on whole texts.

No link between different sets is lost: a pair is left out only when its sets
are already connected or provably below the threshold.

Nulls, empties, repeats: a null or empty text has no shingles and links with
nothing; equal sets are one class and always linked; repeated rows each get
their row; a null doc_id keeps its links but never names a component.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.columns import hidden, shown
from quarry.llm.components import components
from quarry.llm.shingles import mix, shingle_sets
from quarry.llm.sketch import has_bit, slot_bits
from quarry.llm.storage import Stage

PERCENT = 80
#: A slot this far above what chance gives marks its tokens frequent.
FREQUENT = 32
#: Size of an octave's smallest set for each class of its frequent tokens.
PER_CLASS = 8

_PAIR = np.array([0xA24BAED4963EE407, 0x9FB21C651E98DF25], dtype=np.uint64)
_SIGNED = "doc_id long, th long, n int, rare int, sid long, digest binary, sigs array<long>"


def _frequent(counts: np.ndarray) -> np.ndarray:
    mean = counts.mean()
    return counts > mean + 8 * np.sqrt(mean) + FREQUENT


def least_overlap(n):
    """Tokens that a partner of a set of n tokens shares at least."""
    return (PERCENT * n + 99) // 100


def _pairs(tokens: np.ndarray, need: int, octave: int) -> np.ndarray:
    """Signatures of pairs of frequent tokens that cover ``need`` more."""
    groups = np.uint64(max(1, (1 << octave) // PER_CLASS))
    salt = mix(np.array([octave], dtype=np.uint64))
    kind = (tokens % groups).astype(np.int64)
    order = np.argsort(kind, kind="stable")
    new = np.ones(len(tokens), dtype=bool)
    new[1:] = kind[order][1:] != kind[order][:-1]
    first = np.empty(len(tokens), dtype=bool)  # of its class, by the global order
    first[order] = new
    covered = np.cumsum(~first)
    used = int(np.searchsorted(covered, need)) + 1
    own = order[order < used]
    kind, tokens = kind[own], tokens[own]
    out, lag = [], 1
    while True:
        same = np.flatnonzero(kind[:-lag] == kind[lag:]) if lag < len(kind) else []
        if not len(same):
            break
        out.append(mix(tokens[same] * _PAIR[0] + tokens[same + lag] * _PAIR[1] + salt))
        lag += 1
    return np.concatenate(out) | np.uint64(1) if out else np.zeros(0, dtype=np.uint64)


def signatures(tokens: np.ndarray, bits: np.ndarray) -> tuple[int, np.ndarray]:
    """(rare tokens, or -1 if the prefix ends among them; signatures) of a set
    of ascending hashes. Odd signatures are pairs."""
    n = len(tokens)
    if n < 2:  # equal sets need no signature, and others are too far
        return -1, tokens[:0]
    often = has_bit(bits, tokens)
    rare, need = tokens[~often], n - least_overlap(n) + 1
    singles = rare[:need] & ~np.uint64(1)
    if len(singles) == need:
        return -1, np.unique(singles)
    octaves = {n.bit_length() - 1, (n * 100 // PERCENT).bit_length() - 1}
    return len(rare), np.unique(np.concatenate([singles, *(_pairs(tokens[often], need - len(singles), o) for o in octaves)]))


def _sign(bits):
    def run(batches):
        seen = set()
        for batch in batches:
            n, rare, sid, digests, sigs = [], [], [], [], []
            for tokens in shingle_sets(batch.column("text")):
                digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                n.append(len(tokens))
                digests.append(digest)
                sid.append(int.from_bytes(digest[:8], "little", signed=True))
                few, own = signatures(tokens, bits.value)
                rare.append(few)
                sigs.append(own[:0] if digest in seen else own)  # copies in one task sign once
                seen.add(digest)
            ends = np.cumsum([0, *map(len, sigs)])
            values = np.concatenate(sigs).view(np.int64) if sigs else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("th"), pa.array(n, pa.int32()), pa.array(rare, pa.int32()),
                pa.array(sid, pa.int64()), pa.array(digests, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))],
                ["doc_id", "th", "n", "rare", "sid", "digest", "sigs"])
    return run


def _lists(signed: DataFrame) -> DataFrame:
    """(sig, sid, lo, hi): members of each signature's list with two sets or
    more, and the list's two centres.

    A rare token's list is short by the definition of rare, so one window finds
    its extremes. Very many sets may share a pair of frequent tokens: there the
    extremes are aggregated before the shuffle and joined back, so that the
    list's rows are dealt with like those of any skewed join."""
    rows = signed.select(F.explode("sigs").alias("sig"), "sid", "rare")
    own = Window.partitionBy("sig")
    singles = rows.where("sig & 1 = 0").select(
        "sig", "sid", F.min("sid").over(own).alias("lo"), F.max("sid").over(own).alias("hi")).where("lo < hi")
    pairs = rows.where("sig & 1 = 1").select("sig", "sid", F.struct("rare", "sid").alias("by"))
    ends = pairs.groupBy("sig").agg(F.min("by.sid").alias("l"), F.max("by.sid").alias("hi"), F.min("by").alias("lo")) \
        .where("l < hi").select("sig", "lo.sid", "hi").withColumnRenamed("sid", "lo")
    pairs = pairs.select("sig", "sid")
    return singles.unionByName(pairs.join(ends, "sig")).distinct()


def _verify(batches):
    """Rows (a, b, digests, texts of two sets): the linked pairs."""
    last, left = None, None
    for batch in batches:
        out_a, out_b = [], []
        rights = shingle_sets(batch.column("tb"))
        da, db = batch.column("da").to_pylist(), batch.column("db").to_pylist()
        for i, right in enumerate(rights):
            if da[i] != last:
                last, left = da[i], next(shingle_sets(batch.column("ta").slice(i, 1)))
            both = len(np.intersect1d(left, right, assume_unique=True))
            if 100 * both >= PERCENT * (len(left) + len(right) - both):
                out_a.append(da[i])
                out_b.append(db[i])
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.binary()), pa.array(out_b, pa.binary())], ["u", "v"])


def _digested(chosen):
    """Rows (h, text) whose h has a bit: digest and text."""
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(has_bit(chosen.value, batch.column("h").to_numpy().view(np.uint64))))
            digests = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), batch.column("text")], ["digest", "text"])
    return run


def _linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, stage: Stage) -> DataFrame:
    """pairs (a, b) of set ids -> (u, v): digests of those that link, verified on
    whole texts. Bits of the wanted documents (8 MB) spare the others a shuffle."""
    wanted = sets.join(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi")
    chosen = docs.sparkSession.sparkContext.broadcast(slot_bits(
        wanted.select(F.xxhash64("doc_id").alias("h")),
        lambda batch: [batch.column(0).to_numpy().view(np.uint64)], lambda counts: counts > 0))
    found = docs.where("text is not null").select(F.xxhash64("doc_id").alias("h"), "text") \
        .mapInArrow(_digested(chosen), "digest binary, text string")
    texts = stage.write(found.join(wanted.select("digest", "sid"), "digest")
                        .groupBy("digest", "sid").agg(F.first("text").alias("text")))
    right = pairs.join(texts.select(F.col("sid").alias("b"), F.col("digest").alias("db"),
                                    F.col("text").alias("tb")), "b")
    both = right.join(texts.select(F.col("sid").alias("a"), F.col("digest").alias("da"),
                                   F.col("text").alias("ta")), "a")
    return stage.write(both.select("da", "db", "ta", "tb").mapInArrow(_verify, "u binary, v binary"))


#: Whether two set sizes allow a link.
_CLOSE = f"100 * least(na, nb) >= {PERCENT} * greatest(na, nb)"
_PURE = {x: f"(({PERCENT} * n{x} + 99) div 100) - 1" for x in "ab"}
#: The largest overlap of two sets that share ``singles`` rare signatures in all.
_MOST = f"""(singles + case when rarea < 0 and rareb < 0 then greatest({_PURE["a"]}, {_PURE["b"]})
    when rarea < 0 then {_PURE["a"]} when rareb < 0 then {_PURE["b"]}
    else least(na - rarea, nb - rareb) end)"""
_ENOUGH = f"{100 + PERCENT} * {_MOST} >= {PERCENT} * (na + nb)"
#: Sets whose frequent tokens are too few to link by themselves share a rare one, too.
_BY_PAIR = f"sig & 1 = 0 or {100 + PERCENT} * least(na - rarea, nb - rareb) >= {PERCENT} * (na + nb)"


def link_sets(docs: DataFrame, stage: Stage) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text hash, n, digest) of every row, and (node, component) over digests."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bits = spark.sparkContext.broadcast(slot_bits(
        docs.select("text"), lambda batch: shingle_sets(batch.column(0)), _frequent))
    signed = stage.write(docs.withColumn("th", F.xxhash64("text")).mapInArrow(_sign(bits), _SIGNED))
    lists = stage.write(_lists(signed))
    sets = stage.write(signed.where("n > 0").groupBy("digest", "sid", "n", "rare").agg(F.min("doc_id").alias("doc_id")))

    def side(table, x, *more):
        return table.select(*(F.col(c).alias(c + x) for c in ("sid", "n", "rare")), *more)

    # pairs with a list's centre; those that share too few signatures there wait for the next step
    singles = F.sum(F.expr("cast(sig & 1 = 0 as int)")).alias("singles")
    centred = lists.select("sig", F.explode(F.array("lo", "hi")).alias("a"), F.col("sid").alias("b")).where("a != b") \
        .select("sig", F.least("a", "b").alias("sida"), F.greatest("a", "b").alias("sidb")).groupBy("sida", "sidb").agg(singles)
    tried = stage.write(centred.join(side(sets, "a"), "sida").join(side(sets, "b"), "sidb").where(_CLOSE).where(_ENOUGH)
                        .select(F.col("sida").alias("a"), F.col("sidb").alias("b")))
    links = _linked(tried, docs, sets, stage)
    groups = stage.write(components(links))

    # what is left: pairs in one list, of different components
    own = sets.join(groups.withColumnRenamed("node", "digest"), "digest", "left") \
        .select("sid", "n", "rare", F.coalesce("component", "digest").alias("c"))
    rows = lists.select("sig", "sid").join(own, "sid")
    open_lists = rows.groupBy("sig").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 != c1").select("sig")
    rows = stage.write(rows.join(open_lists, "sig", "left_semi"))
    met = side(rows, "a", "sig", F.col("c").alias("ca")).join(side(rows, "b", "sig", F.col("c").alias("cb")), "sig") \
        .where("sida < sidb and ca != cb").where(_CLOSE).where(_BY_PAIR)
    counted = met.groupBy("sida", "sidb", "na", "nb", "rarea", "rareb").agg(singles)
    rest = stage.write(counted.where(_ENOUGH).select(F.col("sida").alias("a"), F.col("sidb").alias("b"))
                       .join(tried, ["a", "b"], "left_anti"))
    if not rest.isEmpty():
        groups = components(links.unionByName(_linked(rest, docs, sets, stage)))
    return signed.select("doc_id", "th", "n", "digest"), groups


def _with_component(docs: DataFrame) -> tuple[DataFrame, DataFrame, Stage]:
    """(doc_id, th, n, digest, component) of the rows with shingles; (doc_id, th, n)
    of the others, which link with nothing and so meet no join."""
    stage = Stage(docs.sparkSession, "jaccard")
    rows, groups = link_sets(docs, stage)
    groups = stage.write(groups.withColumnRenamed("node", "digest"))
    found = rows.where("n > 0").join(groups, "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    return found, rows.where("n = 0").select("doc_id", "th", "n"), stage


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_texts): for each row of ``docs``
    (doc_id, text; more columns are ignored) its set's size, the smallest
    doc_id that links reach, and how many different sets its component has."""
    rows, empty, stage = _with_component(docs)
    # written, so that a component with very many rows is dealt with as a skewed join
    rows = stage.write(rows)
    named = stage.write(rows.groupBy("component").agg(
        F.min("doc_id").alias("component_id"), F.count_distinct("digest").alias("n_texts")))
    return rows.join(named, "component").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", "n_texts").unionByName(empty.select(
            "doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"),
            F.lit(1).cast("long").alias("n_texts")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component stays, the one with the smallest doc_id
    (then text hash); documents without shingles stay too. Columns are those of
    ``docs``. A document is a doc_id with a text: rows that repeat both are one
    (one row stays), other texts of a doc_id are judged by themselves. Rows
    without a doc_id all stay, for no decision can name them."""
    rows, empty, _ = _with_component(docs)
    keep = rows.where("doc_id is not null").groupBy("component").agg(F.min(F.struct("doc_id", "th")).alias("least")) \
        .select("least.*").unionByName(empty.where("doc_id is not null").select("doc_id", "th").distinct())
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    first = Window.partitionBy("doc_id", "th").orderBy("th")
    named = hidden(docs, doc_id, F.xxhash64(F.col("text").cast("string")).alias("th")).join(keep, ["doc_id", "th"], "left_semi") \
        .withColumn("row", F.row_number().over(first)).where("row = 1")
    return shown(named, docs).unionByName(docs.where("doc_id is null"))
