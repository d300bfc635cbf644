"""Operator 7: document fingerprints as invertible Bloom lookup sketches.

DataFrame expressions only. A text is cut into paragraph pieces: its lines, and
within them its sentences, so that an edit inside a long line leaves the other
pieces alone. A text is the set of its pieces' digests (64-bit hashes); order and
repeats of pieces do not count.

A sketch has three tables of cells. A digest falls into one cell of each; a cell
holds the count, the xor of its digests and the xor of their checks. Sketches of
two versions subtract cell by cell, which cancels what both hold. A cell with
count +1 or -1 and a fitting check is pure: it shows a digest of one side, which
is taken out of its other cells, and so on (peeling) until nothing is left.
Likeness is the share of common digests in all, from the two counts and the
number of recovered ones.

The fingerprint is the sketch of ``CELLS`` cells a table; it is subtracted and
peeled as arrays, within the row. Where something is left, the pair's large
sketches decide, with tables in proportion to its digests (they are built beside
the small ones: waiting for those would repeat the costlier half of the work for
every pair that fails). Large sketches are kept sparse, one row per
occupied cell, with all rows of a document in one partition: documents are
exchanged once by id, and building, subtracting and peeling are aggregates within
that partitioning, linear in the digests. A round of peeling looks at one table
only, where every digest has one cell, so that it is taken out once. Should even
that leave something (two digests that share all three cells: about one pair in
ten million), the digests are compared themselves.

The next document by descending doc_id comes from range-partitioned ids: each
range's first id is handed to the range before. Only ids move for that.

A null text is empty; an empty text has no pieces, and two empty texts have
likeness 1. Rows that repeat a doc_id and text share a next document (the next
that differs); a doc_id with several texts orders them by text hash; a null
doc_id comes last. The only document is its own next one. More columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.session import cut_lineage

CELLS, BITS = 4, 2
#: Cells per digest of the pair, and a few more, in each table of the retry.
ROOM, LEAST = 64, 64
ROUNDS = 6
PIECES = r"\n|(?<=[.!?])\x20"


def pieces(text: Column) -> Column:
    """Digests of a text's pieces, each once."""
    found = F.filter(F.split(text, PIECES, -1), lambda p: p != "")
    return F.array_distinct(F.transform(found, lambda p: F.xxhash64(p)))


def _place(digest: str, table: str, cells: str) -> str:
    return f"pmod(xxhash64({digest}, {table}), {cells})"


def _check(digest: str) -> str:
    return f"shiftrightunsigned(xxhash64({digest}, 77), 32)"


def _small(digest: str, table: str) -> str:
    """The digest's cell in a table of the small sketch: digests are hashes, so bits of them will do."""
    return f"(shiftright({digest}, cast({BITS} * ({table}) as int)) & {CELLS - 1}L)"


def sketch(digests: str) -> str:
    """Cells of an array of digests: (n, key, chk) of the three tables."""
    return "array(" + ", ".join(f"""aggregate(
        filter({digests}, d -> {_small("d", str(c // CELLS))} = {c % CELLS}L),
        named_struct('n', 0, 'key', 0L, 'chk', 0L),
        (s, d) -> named_struct('n', s.n + 1, 'key', s.key ^ d, 'chk', s.chk ^ {_check("d")}))"""
                                for c in range(3 * CELLS)) + ")"


def _written(cells: str) -> str:
    return f"lower(concat_ws(',', transform({cells}, s -> concat(hex(s.n), ':', hex(s.key), ':', hex(s.chk)))))"


def _subtracted(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'key', x.key ^ y.key, 'chk', x.chk ^ y.chk))"


def peeled(cells: str) -> str:
    """The digests that differ, by peeling; null if something is left."""
    pure = f"""abs(x.n) = 1 and x.chk = {_check("x.key")} and {_small("x.key", f"k div {CELLS}")} = k % {CELLS}"""
    first = f"array_position(transform(CELLS_HERE, (x, k) -> {pure}), true)"
    key = "element_at(s.c, cast(s.p as int)).key"
    without = f"""transform(s.c, (x, k) -> if({_small(key, f"k div {CELLS}")} = k % {CELLS},
        named_struct('n', x.n - element_at(s.c, cast(s.p as int)).n, 'key', x.key ^ {key}, 'chk', x.chk ^ {_check(key)}), x))"""
    state = "named_struct('c', {c}, 'p', " + first.replace("CELLS_HERE", "{c}") + ", 'd', {d})"
    begin = state.format(c="z", d="cast(array() as array<bigint>)")
    step = f"""if(s.p = 0, s, element_at(transform(array({without}), z -> {state.format(c="z", d=f"concat(s.d, array({key}))")}), 1))"""
    return f"""element_at(transform(array({cells}), z -> aggregate(sequence(1, {3 * CELLS}), {begin}, (s, i) -> {step},
        s -> if(forall(s.c, x -> x.n = 0 and x.key = 0 and x.chk = 0), s.d, null))), 1)"""


def successors(versions: DataFrame) -> DataFrame:
    """(id, th, k, next_id, next_th) of the distinct (id, th, k, doc_id): the next
    in descending doc_id (null last), then by th; the last one's is the first."""
    order = [F.col("doc_id").desc_nulls_last(), F.col("th")]
    ranged = cut_lineage(versions.distinct().repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(*order)
    ranged = ranged.withColumn("next", F.lead(F.struct("id", "th")).over(within)).withColumn(
        "row", F.row_number().over(within))
    # one row per range: its first id goes to the range before, the very first to the last
    by_part = Window.orderBy("part")
    heads = ranged.where("row = 1").select("part", F.struct("id", "th").alias("head")).select(
        "head", F.coalesce(F.lag("part").over(by_part), F.max("part").over(Window.partitionBy())).alias("part"))
    linked = ranged.join(F.broadcast(heads), "part", "left").withColumn("next", F.coalesce("next", "head"))
    return linked.select("id", "th", "k", F.col("next.id").alias("next_id"), F.col("next.th").alias("next_th"))


def _retried(pairs: DataFrame) -> DataFrame:
    """(id, th, pair, a, b) with digests of both sides -> (id, th, pair,
    recovered, left): number of digests recovered from large sketches, and of
    cells that are left. Everything stays in the partition of (id, th)."""
    by = ["id", "th", "pair", "t"]

    def cell(j, digest, sign, chk):
        return (f"named_struct('cell', {j} * t + {_place(digest, str(j), 't')}, 'rk', 0L, 'n', {sign}, "
                f"'key', {digest}, 'chk', {chk})")

    # plain arrays of structs, no lambdas: the whole chain is compiled
    rows = pairs.withColumn("t", F.expr(f"cast({ROOM} * (size(a) + size(b)) + {LEAST} as bigint)")).select(
        *by, F.expr("explode(array(named_struct('ds', a, 's', 1L), named_struct('ds', b, 's', -1L))) as x")) \
        .select(*by, "x.s", F.explode("x.ds").alias("d")).select(*by, "s", "d", F.expr(_check("d")).alias("c"))
    rows = rows.select(*by, F.expr(f"explode(array({', '.join(cell(j, 'd', 's', 'c') for j in range(3))})) as y")) \
        .select(*by, "y.*")

    def summed(rows):
        return rows.groupBy(*by, "cell", "rk").agg(F.sum("n").alias("n"), F.expr("bit_xor(key) as key"),
                                                   F.expr("bit_xor(chk) as chk")).where("n != 0 or key != 0 or chk != 0")

    rows = summed(rows)
    for r in range(ROUNDS):
        # a pure cell gives way to what it shows, and takes that out of the other two tables
        pure = f"cell >= 0 and cell div t = {r % 3} and abs(n) = 1 and chk = {_check('key')}"
        own = "named_struct('cell', cell, 'rk', rk, 'n', n, 'key', key, 'chk', chk)"
        found = "named_struct('cell', -1L, 'rk', key, 'n', n, 'key', 0L, 'chk', 0L)"
        out = ", ".join(cell(j, "key", "-n", "chk") for j in range(3) if j != r % 3)
        rows = summed(rows.select(*by, F.expr(f"explode(if({pure}, array({found}, {out}), array({own}))) as y"))
                      .select(*by, "y.*"))
    return rows.groupBy("id", "th", "pair").agg(F.expr("count_if(cell < 0) as recovered"),
                                                F.expr("count_if(cell >= 0) as left"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next): for each row its text against the text whose last
    third gives way to the beginning of the next document's, and against that
    document."""
    doc_id = F.col("doc_id").cast("long")
    # (id, th) names a version; neither is ever null, so that one exchange serves every join and aggregate.
    # The text hash is odd where doc_id is null.
    own = docs.select(doc_id.alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).select(
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.expr("xxhash64(text) & ~1L | if(doc_id is null, 1L, 0L)").alias("th"), "text")
    named = F.when(F.expr("th & 1 = 0"), F.col("id"))
    after = successors(own.select(named.alias("doc_id"), "id", "th", F.expr("char_length(text) div 3 as k")))
    own = own.withColumn("a", pieces(F.col("text")))
    # the next document's beginning and digests, brought to the row they are for
    given = after.withColumnsRenamed({"id": "i", "th": "h"}).join(
        own, (F.col("next_id") == F.col("id")) & (F.col("next_th") == F.col("th"))).select(
            "i", "h", F.struct(F.expr("substring(text, 1, k)").alias("begin"), F.col("a").alias("b")).alias("g")) \
        .groupBy("i", "h").agg(F.first("g").alias("g"))
    rows = own.join(given, (F.col("id") == F.col("i")) & (F.col("th") == F.col("h"))).select(
        "id", "th", F.char_length("text").cast("long").alias("n_chars"), "a", F.col("g.b").alias("b"),
        F.expr("concat(substring(text, 1, char_length(text) - char_length(text) div 3), g.begin)").alias("edited"))
    keys = ["id", "th", "n_chars"]
    rows = rows.select(*keys, "a", "b", F.sha2("edited", 256).alias("edited_sha256"), pieces(F.col("edited")).alias("e"))
    cells = rows.select("*", F.expr(sketch("a")).alias("ca"), F.expr(sketch("e")).alias("ce"), F.expr(sketch("b")).alias("cb"))
    tried = cells.select(*keys, "edited_sha256", "a", "e", "b", F.expr(_written("ca")).alias("fingerprint"),
                         F.expr(_written("ce")).alias("edited_fingerprint"),
                         F.expr(peeled(_subtracted("ca", "ce"))).alias("de"), F.expr(peeled(_subtracted("ca", "cb"))).alias("db"))
    again = _retried(rows.select("id", "th", "a", F.explode(F.array(
        F.struct(F.lit(0).alias("pair"), F.col("e").alias("b")),
        F.struct(F.lit(1).alias("pair"), F.col("b").alias("b")))).alias("p")).select("id", "th", "p.pair", "a", "p.b"))
    again = again.groupBy(F.col("id").alias("i"), F.col("th").alias("h")).agg(
        *(F.max(F.when((F.col("pair") == p) & (F.col("left") == 0), F.col("recovered"))).alias(f"r{p}") for p in (0, 1)))
    tried = tried.join(again, (F.col("id") == F.col("i")) & (F.col("th") == F.col("h")), "left")

    def near(other, peeled_, retried):
        differ = f"coalesce(size({peeled_}), {retried}, size(array_except(a, {other})) + size(array_except({other}, a)))"
        # size(null) is null under ANSI
        return F.expr(f"""if(size(a) + size({other}) = 0, 1D,
            (size(a) + size({other}) - {differ}) / (size(a) + size({other}) + {differ}))""")

    return tried.select(named.alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
                        near("e", "de", "r0").alias("near_edited"), near("b", "db", "r1").alias("near_next"))
