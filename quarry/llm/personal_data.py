"""Operator 11: personal data by patterns and by bootstrapped contexts.

Four base patterns give seed entities: e-mail and IP addresses, card numbers (14
to 19 digits that pass Luhn's test) and phone numbers with a plus sign. The
finders are linear in the text, whatever it holds: each starts only where a run
of its characters starts.

The contexts of the seeds are then used to find identifiers that no pattern knows
(the scheme of DIPRE, Snowball and Basilisk):

* *Candidates* are other stretches of identifier characters with ``DIGITS`` digits
  or more, with number groups that follow after single spaces. An *instance* is
  the text of a seed or candidate, lower-cased.
* A *lexical pattern* is the word before, the two words before, or the words on
  either side, lower-cased, digits as 9, within a line and ``NEAR`` code points; a
  pattern's word next to the instance must hold a letter.
* Patterns and instances form a graph with one edge per different pair, whatever
  the number of copies. A pattern's confidence for a kind is ``known / (known +
  others + UNKNOWN * unknown + 1)``: known instances of that kind, of other kinds,
  and unknown ones, which speak against it less. It is used from ``SUPPORT`` known
  instances and a confidence of ``PATTERN`` on. An instance's score is
  ``1 - product of (1 - confidence)`` over its used patterns; from ``INSTANCE`` on
  it counts as known in the next round, and its own contexts become patterns.
  Rounds end when nothing is new, after ``ROUNDS`` at most (a parameter of the
  method: later rounds drift).
* An occurrence of a discovered instance in a used pattern becomes a span of kind
  ``ctx_`` and the seeds' kind. Base spans stay and are never overlapped.

One pass over the texts writes each row's spans and candidates to a table in the
shared folder; rounds are joins and aggregates of the graph's edges. Copies of a
text send their candidates once (by digest, before the shuffle). Only used
patterns, and only discovered pairs, are joined back, over ``SALT`` salts, since a
pattern, a pair or a text may belong to a third of all rows. Nothing is collected
but a count a round.

A null or empty text has no spans. Repeated rows each get their row; doc_id may be
null; more columns are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.storage import Stage

#: In the order of equal starts.
KINDS = ("email", "ip", "card", "phone")
DIGITS = 4
NEAR = 80
SUPPORT = 8
UNKNOWN = 0.1
PATTERN = 0.8
INSTANCE = 0.9
ROUNDS = 5
SALT = 16

_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_OTHER = re.compile(r"(?<![A-Za-z0-9@_./+-])[A-Za-z0-9@_./+-]*[0-9][A-Za-z0-9@_./+-]*(?:\x20\(?[0-9][0-9().-]*)*")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LETTER = re.compile(r"[^\W\d_]")

_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"
_FOUND = (f"doc_id long, digest binary, base {_SPANS}, "
          "candidates array<struct<start:int,end:int,rank:int,instance:string,patterns:array<string>>>")
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))
_CANDIDATE_TYPE = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("rank", pa.int32()),
                                      ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text):
    end = 0
    for m in _LOCAL.finditer(text):
        start = max(m.start(), end)  # a match may end within the run
        if start < m.end() - 1 and (domain := _DOMAIN.match(text, m.end())):
            end = domain.end()
            yield start, end


def _numbers(text):
    """(rank, start, end) of IP addresses, cards and phones."""
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m.group().split(".")):
            yield 1, *m.span()
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            yield 2, *m.span()
    for m in _PHONE.finditer(text):
        if 10 <= len(_DIGIT.findall(m.group())) <= 15:
            yield 3, *m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, rank, end) by start, then kind."""
    found = [(start, 0, end) for start, end in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        found += [(start, rank, end) for rank, start, end in _numbers(text)]
    return sorted(found)


def _shape(word: str) -> str:
    return _DIGIT.sub("9", word.lower())


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around text[start:end]."""
    before = text[max(0, start - NEAR):start]
    before = [_shape(w) for w in _WORD.findall(before[before.rfind("\n") + 1:])[-2:]]
    if not before or not _LETTER.search(before[-1]):
        return []
    after = _WORD.search(text[end:end + NEAR].split("\n", 1)[0])
    out = [f"1 {before[-1]}"] + ([f"2 {' '.join(before)}"] if len(before) == 2 else [])
    return out + ([f"m {before[-1]} _ {_shape(after.group())}"] if after else [])


def _others(text, taken):
    """(start, end) of stretches with ``DIGITS`` digits that touch no span of ``taken``."""
    at = 0
    for m in _OTHER.finditer(text):
        own = m.group()
        start = m.start() + len(own) - len(own.lstrip("@_./+-"))
        end = m.end() - (len(own) - len(own.rstrip("@_./+-(")))
        while at < len(taken) and taken[at][1] <= start:
            at += 1
        if (at == len(taken) or taken[at][0] >= end) and len(_DIGIT.findall(text, start, end)) >= DIGITS:
            yield start, end


def _union(spans):
    """Spans (start, rank, end) without overlaps, by start."""
    out = []
    for start, _, end in spans:
        if out and start < out[-1][1]:
            out[-1][1] = max(end, out[-1][1])
        else:
            out.append([start, end])
    return out


def _find(batches):
    for batch in batches:
        digests, bases, candidates = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            digests.append(hashlib.blake2b(text.encode(), digest_size=16).digest())
            base = base_spans(text)
            bases.append([{"start": s, "rank": r, "end": e, "kind": KINDS[r]} for s, r, e in base])
            places = [(s, e, r) for s, r, e in base]
            if _DIGIT.search(text):
                places += [(s, e, None) for s, e in _others(text, _union(base))]
            candidates.append([{"start": s, "end": e, "rank": r, "instance": text[s:e].lower(), "patterns": own}
                               for s, e, r in places if (own := patterns(text, s, e))])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(digests, pa.binary()), pa.array(bases, _SPAN_TYPE),
             pa.array(candidates, _CANDIDATE_TYPE)], ["doc_id", "digest", "base", "candidates"])


def find(docs: DataFrame, stage: Stage) -> DataFrame:
    """(doc_id, digest, base, candidates) of every row of ``docs`` (doc_id, text)."""
    return stage.write(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_find, _FOUND))


def _salted(table: DataFrame) -> DataFrame:
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _salt(*columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(SALT)).cast("int").alias("salt")


def occurrences(found: DataFrame) -> DataFrame:
    """(digest, start, end, rank, instance, pattern): one row per different text,
    place and pattern; rank is null for candidates."""
    rows = found.where(F.size("candidates") > 0).select("digest", F.explode("candidates").alias("c")) \
        .select("digest", "c.start", "c.end", "c.rank", "c.instance", F.explode("c.patterns").alias("pattern"))
    return rows.distinct()


def used_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, kind, confidence) of the patterns that may discover, from edges
    (pattern, instance, kind; null where the instance is unknown)."""
    counted = edges.groupBy("pattern").agg(
        F.count("*").alias("n"), *(F.sum(F.when(F.col("kind") == k, 1).otherwise(0)).alias(f"k{k}") for k in range(len(KINDS))))
    known = F.greatest(*(F.col(f"k{k}") for k in range(len(KINDS))))
    kind = F.coalesce(*(F.when(F.col(f"k{k}") == known, k) for k in range(len(KINDS))))
    every = sum(F.col(f"k{k}") for k in range(len(KINDS)))
    confidence = known / (every + UNKNOWN * (F.col("n") - every) + 1)
    return counted.select("pattern", kind.alias("kind"), known.alias("known"), confidence.alias("confidence")) \
        .where((F.col("known") >= SUPPORT) & (F.col("confidence") >= PATTERN))


def discovered(edges: DataFrame, used: DataFrame) -> DataFrame:
    """(instance, kind, score): unknown instances that used patterns make known."""
    weighed = edges.where("kind is null").select("pattern", "instance", _salt("instance")).join(
        _salted(used.select("pattern", F.col("kind").alias("kind"), "confidence")), ["pattern", "salt"])
    scored = weighed.groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score")) \
        .where(F.col("score") >= INSTANCE)
    return scored.groupBy("instance").agg(F.min(F.struct((-F.col("score")).alias("less"), "kind")).alias("b")) \
        .select("instance", "b.kind", (-F.col("b.less")).alias("score"))


def bootstrap(seen: DataFrame, stage: Stage, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(patterns, instances): used patterns and discovered instances, from ``occurrences``."""
    pairs = seen.groupBy("pattern", "instance").agg(F.min("rank").alias("kind"))
    # an instance is known where any of its occurrences is a seed
    known = seen.where("rank is not null").groupBy("instance").agg(F.min("rank").alias("seed"))
    edges = stage.write(pairs.join(known, "instance", "left").select(
        "pattern", "instance", F.coalesce("kind", "seed").alias("kind")))
    found = None
    for _ in range(rounds):
        new = stage.write(discovered(edges, used_patterns(edges)))
        if new.isEmpty():
            break
        found = new if found is None else found.unionByName(new)
        edges = stage.write(edges.join(new.select("instance", F.col("kind").alias("now")), "instance", "left").select(
            "pattern", "instance", F.coalesce("kind", "now").alias("kind")))
    used = stage.write(used_patterns(edges))
    return used, found if found is not None else new


def added_spans(seen: DataFrame, used: DataFrame, instances: DataFrame) -> DataFrame:
    """(digest, added): the spans of discovered instances in used patterns."""
    pairs = seen.where("rank is null").select("pattern", "instance").distinct() \
        .join(instances.select("instance", "kind"), "instance") \
        .join(used.select("pattern", F.col("kind").alias("of")), "pattern").where("kind = of").select("pattern", "instance", "kind")
    places = seen.where("rank is null").withColumn("salt", _salt("digest")).join(
        _salted(pairs), ["pattern", "instance", "salt"]).select("digest", "start", "end", "kind").distinct()
    names = F.array(*(F.lit(f"ctx_{k}") for k in KINDS))
    span = F.struct("start", (F.col("kind") + len(KINDS)).cast("int").alias("rank"), "end",
                    F.element_at(names, F.col("kind") + 1).alias("kind"))
    return places.groupBy("digest").agg(F.array_sort(F.collect_list(span)).alias("added"))  # the spans of one text


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, base, added) of every row: arrays of spans (start, rank, end,
    kind), code points, end exclusive, by start; the two do not overlap."""
    stage = Stage(docs.sparkSession, "personal")
    found = find(docs, stage)
    seen = stage.write(occurrences(found))
    added = stage.write(added_spans(seen, *bootstrap(seen, stage, rounds)))
    return found.select("doc_id", "digest", "base", _salt("doc_id")).join(_salted(added), ["digest", "salt"], "left") \
        .select("doc_id", "base", F.coalesce("added", F.array().cast(_SPANS)).alias("added"))


def _written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added)."""
    def of(kind):
        return lambda s: s["kind"] == kind

    counts = [F.size(F.filter("base", of(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return personal_data(docs).select(
        "doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
