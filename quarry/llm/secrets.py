"""Operator 6: secrets by patterns and by character Markov models.

DataFrame expressions only. Three patterns give the base spans: assignments of a
value of six or more characters, access keys of 20 or more, and runs of 24 or
more hex digits. Matches are found leftmost and non-overlapping per kind; the
text between them (``split``) gives their places in code points.

Two first-order Markov models of characters, one of random strings and one of
ordinary identifiers, are trained from labelled samples by one aggregate of
character pairs. Any other run of ``CANDIDATE`` characters whose log-likelihood
ratio passes ``RATIO`` in all and ``PER_PAIR`` on average is added as a span of
kind ``markov``, if it overlaps no base span. The models become one literal
array of log ratios (80 x 80 numbers, whatever the input).

The labelled samples of the query are strings of a bounded number of documents
(``SAMPLE``, by hash of doc_id): what the patterns found is random, other runs
of the same characters are ordinary. Fitting reads no more; scanning reads every
whole text.

A null or empty text has no spans. Repeated rows each get their row; doc_id may
be null; more columns are kept by ``redact`` and ignored elsewhere. Without any
sample the models are equal and add nothing.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.columns import hidden, shown

#: kind, pattern, group of the secret itself, its least length; in the order of equal starts.
KINDS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    # a maximal run of hex digits, so that only runs long enough are cut out
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
SAMPLE = 5000
RATIO = 12.0
PER_PAIR = 0.6
#: Pairs back off to single characters, and those to equal chances.
BACKOFF, SMOOTHING = 20.0, 0.5
MASK = "[SECRET]"
#: Characters of the pieces that texts with spans are taken from.
PIECE = 2048

_FIRST, _WIDTH = 43, 80  # '+' to 'z'


def _spans(text: Column, pattern: str, keep: Column, kind: str, rank: int) -> Column:
    """Spans of the matches whose flag in ``keep`` (one per match) is set."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    parts = F.arrays_zip(found.alias("m"), F.slice(between, 1, F.size(found)).alias("b"), keep.alias("k"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")

    def add(acc, x):
        start = acc["at"] + F.length(x["b"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["k"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    folded = F.aggregate(parts, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(F.rlike(text, F.lit(pattern)), folded).otherwise(none)


def _at_least(n: int):
    return lambda value: F.length(value) >= n


def _of(kind: str):
    return lambda span: span["kind"] == kind


def _base(text: Column) -> Column:
    lists = []
    for rank, (kind, pattern, group, least) in enumerate(KINDS):
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
        lists.append(_spans(text, pattern, F.transform(values, _at_least(least)), kind, rank))
    return F.array_sort(F.concat(*lists))


def samples(docs: DataFrame) -> DataFrame:
    """(string, label) from a bounded number of documents: 1 what the patterns
    found, 0 other runs of characters of six or more."""
    ids = docs.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.join(F.broadcast(ids), "doc_id", "left_semi").select(text.alias("text"))
    secret = F.concat(*(F.filter(F.regexp_extract_all("text", F.lit(p), F.lit(g)), _at_least(n))
                        for _, p, g, n in KINDS))
    rest = F.col("text")
    for _, pattern, _, _ in KINDS:
        rest = F.regexp_replace(rest, pattern, " ")
    plain = F.regexp_extract_all(rest, F.lit(r"[A-Za-z0-9+/_=-]{6,}"), F.lit(0))
    return docs.select(F.explode(F.array(
        F.struct(F.array_distinct(secret).alias("strings"), F.lit(1).alias("label")),
        F.struct(F.array_distinct(plain).alias("strings"), F.lit(0).alias("label")))).alias("s")) \
        .select("s.strings", "s.label").select(F.explode("strings").alias("string"), "label")  # rows without the array


def _codes(string: Column) -> Column:
    return F.transform(F.split(string, ""), lambda c: F.ascii(c) - _FIRST)


def train(labelled: DataFrame) -> np.ndarray:
    """Log ratios of character pairs, random against ordinary, from (string,
    label) rows: flat, ``_WIDTH * first + second``. Other characters are skipped."""
    codes = labelled.where("label in (0, 1)").select("label", _codes(F.col("string")).alias("c"))
    pairs = codes.select("label", F.explode(F.arrays_zip(
        F.col("c").alias("a"), F.slice("c", F.lit(2), F.greatest(F.size("c"), F.lit(1))).alias("b"))).alias("p"))
    fine = f"p.a between 0 and {_WIDTH - 1} and p.b between 0 and {_WIDTH - 1}"
    counts = np.zeros((2, _WIDTH, _WIDTH))
    for label, a, b, n in pairs.where(fine).groupBy("label", "p.a", "p.b").count().collect():  # 2 * 80 * 80 at most
        counts[label, a, b] += n
    single = counts.sum(axis=1) + SMOOTHING
    single = single / single.sum(axis=1, keepdims=True)
    chance = (counts + BACKOFF * single[:, None, :]) / (counts.sum(axis=2, keepdims=True) + BACKOFF)
    return np.log(chance[1] / chance[0]).ravel()


def find(docs: DataFrame, ratios: np.ndarray) -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of spans (start, rank, end,
    kind), code points, end exclusive, by start; the two do not overlap."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    table = F.lit(ratios)

    def random(string):
        codes = _codes(string)
        total = F.aggregate(F.zip_with(codes, F.slice(codes, 2, F.length(string)), lambda a, b: F.when(
            a.between(0, _WIDTH - 1) & b.between(0, _WIDTH - 1), F.element_at(table, a * _WIDTH + b + 1))),
            F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))
        return (total >= RATIO) & (total >= PER_PAIR * (F.length(string) - 1))

    flags = F.transform(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), random)
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    marked = docs.withColumn("base", _base(text)).withColumn("_flags", flags).withColumn("added", F.when(
        F.exists("_flags", lambda x: x), _spans(text, CANDIDATE, F.col("_flags"), "markov", len(KINDS))).otherwise(none))
    return marked.withColumn("added", F.filter("added", lambda a: ~F.exists(
        "base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))).drop("_flags")


def _written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = find(docs, train(samples(docs)))
    counts = [F.size(F.filter("base", _of(k))).cast("long").alias(f"n_{k}") for k, *_ in KINDS]
    return found.select("doc_id", *counts, F.size("added").cast("long").alias("n_markov"),
                        F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
                        _written(F.array_sort(F.concat("base", "added"))).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span of the text replaced by ``MASK`` (overlapping
    spans by one) and ``n_chars``, if there is one, set to the new length."""
    found = find(hidden(docs, F.col("text").cast("string").alias("text")), train(samples(docs)))
    # spans without overlaps, then the text between them; parts of the text are taken from pieces
    # of PIECE characters, so that a place far into a long text costs no more than one at its begin
    pair = "array<struct<start:int,end:int>>"

    def join(acc, s):
        last = F.element_at(acc, -1)
        own = F.array(F.struct(s["start"].alias("start"), s["end"].alias("end")))
        return F.when((F.size(acc) == 0) | (s["start"] >= F.try_element_at(acc, F.lit(-1))["end"]), F.concat(acc, own)).when(
            s["end"] <= last["end"], acc).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
                last["start"].alias("start"), s["end"].alias("end")))))

    spans = F.aggregate(F.array_sort(F.concat("base", "added")), F.array().cast(pair), join)
    found = found.withColumn("_spans", F.when(F.size("base") + F.size("added") > 0, spans))
    found = found.withColumn("_parts", F.when(F.isnotnull("_spans"), F.regexp_extract_all(
        "text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    new = F.expr(f"""array_join(transform(
        zip_with(concat(array(0), transform(_spans, s -> s.end)),
                 concat(transform(_spans, s -> s.start), array(char_length(text))), (a, b) -> named_struct('a', a, 'b', b)),
        g -> if(g.a = g.b, '', if(g.a div {PIECE} = (g.b - 1) div {PIECE},
            substring(_parts[cast(g.a div {PIECE} as int)], g.a % {PIECE} + 1, g.b - g.a),
            concat(substring(_parts[cast(g.a div {PIECE} as int)], g.a % {PIECE} + 1, {PIECE}),
                   array_join(slice(_parts, cast(g.a div {PIECE} as int) + 2,
                                    cast((g.b - 1) div {PIECE} - g.a div {PIECE} as int) - 1), ''),
                   substring(_parts[cast((g.b - 1) div {PIECE} as int)], 1, (g.b - 1) % {PIECE} + 1))))), '{MASK}')""")
    new = F.when(F.isnotnull("_spans"), new)
    found = found.withColumn("new", new)
    columns = {"text": F.coalesce("new", "text")}
    if "n_chars" in docs.columns:
        old = F.col(f"_{docs.columns.index('n_chars')}")
        columns["n_chars"] = F.when(F.isnotnull("new"), F.char_length("new").cast("long")).otherwise(old)
    return shown(found, docs, **columns)
