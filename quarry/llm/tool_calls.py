"""Operator 2: chat formatting with tool calls linked to their results.

DataFrame expressions only. Messages are rows (conv_id, turn, kind, call_id,
name, body): kind is ``message``, ``call`` (body: arguments in JSON) or
``result`` (body: what the tool returned).

* Linking is a hash join by (conv_id, call_id) of rows with one row per
  identifier, aggregated before the shuffle: repeats never meet repeats.
* Topological order: a call may name the calls it waits for in its argument
  ``after`` (one identifier or a list). Every row gets a place, at first its turn;
  a call's place is raised above those of the calls it waits for and of their
  results. A transcript in order needs one round. Each round raises every place,
  lets go of waits for calls whose place is final, and hands waits for a call with
  one wait of its own on to that one, so that a chain of n calls ends in log2(n)
  rounds (calls with several waits each: one round for each call in a row). The
  rounds end where nothing moves, or where no further place becomes final: what
  then still waits lies on a cycle or waits for one, gets the error ``cyclic`` and
  keeps the place of its turn. The order within a conversation is
  (place, kind, turn, call_id): there is no window over a conversation, which may
  hold a third of all rows.
* Arguments are checked against a schema: ``{name: {field: (type, required)}}``.
* Each row is serialised as canonical JSON: keys in code point order, no white
  space (the variant type keeps object keys sorted), nulls left out.

Nulls: a call or result without conv_id or call_id links with nothing (error
``no identifier``); null turns have place 0; a null body of a call is malformed
JSON; a null text is serialised without its key. Of calls or results that share
an identifier each stays a row, with error ``repeated``; the earliest (turn, then
body) stands for them. Arguments over 16 MB count as malformed. Empty tables give
empty results, more columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.session import cut_lineage

#: More than any number of calls; waits handed round a cycle stop growing here.
FAR = 1 << 40
_TYPES = {"integer": "BIGINT", "string": "STRING", "boolean": "BOOLEAN"}


def _is(kind: str, found: Column) -> Column:
    """Whether a variant's type (as schema_of_variant says) is a JSON type."""
    if kind == "number":
        return found.rlike("^(BIGINT|DOUBLE|DECIMAL)")
    if kind in ("array", "object"):
        return found.startswith(kind.upper())
    return found == _TYPES[kind]


def argument_errors(name: Column, body: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Errors of a call's arguments (an array of strings, in a fixed order)."""
    args = F.try_parse_json(body)
    none = F.array().cast("array<string>")
    cases = None
    for tool, fields in sorted(schemas.items()):
        found = []
        for field, (kind, required) in sorted(fields.items()):
            value = F.schema_of_variant(F.variant_get(args, f"$['{field}']", "variant"))
            found.append(F.when(value.isNull(), F.lit(f"missing {field}") if required else None)
                         .when(~_is(kind, value), F.lit(f"{field} is no {kind}")))
        known = F.array(*(F.lit(field) for field in sorted(fields)))
        extra = F.transform(F.array_sort(F.array_except(F.coalesce(F.json_object_keys(body), none), known)),
                            lambda k: F.concat(F.lit("unknown "), k))
        errors = F.concat(F.array_compact(F.array(*found)), extra)
        cases = F.when(name == tool, errors) if cases is None else cases.when(name == tool, errors)
    unknown = F.array(F.lit("unknown tool"))
    return F.when(args.isNull() | ~F.schema_of_variant(args).startswith("OBJECT"), F.array(F.lit("malformed arguments"))) \
        .otherwise(unknown if cases is None else cases.otherwise(unknown))


def _waits(body: Column) -> Column:
    """Identifiers that a call waits for."""
    after = F.variant_get(F.try_parse_json(body), "$.after", "variant")
    kind = F.schema_of_variant(after)
    return F.when(kind == "STRING", F.array(F.expr("try_variant_get(try_parse_json(body), '$.after', 'string')"))) \
        .when(kind == "ARRAY<STRING>", F.expr("try_variant_get(try_parse_json(body), '$.after', 'array<string>')")) \
        .otherwise(F.array().cast("array<string>"))


def places(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, place, cyclic) of calls (conv_id, call_id, turn, end,
    waits), one row per identifier; end is the turn of the call's result."""
    by = ["conv_id", "call_id"]
    start = cut_lineage(calls.select(
        *by, F.coalesce("turn", F.lit(0)).alias("turn"), F.coalesce("end", "turn", F.lit(0)).alias("end"),
        F.explode_outer(F.array_distinct("waits")).alias("to")))
    own = start.select(*by, "turn", "end").distinct()
    waits = start.where("to is not null").select(*by, "to", F.lit(1).cast("long").alias("d")).join(
        own.select("conv_id", F.col("call_id").alias("to"), (F.col("end") + 1).alias("least")), ["conv_id", "to"])

    def raised(nodes, waits):
        """Places raised to what the waits (to: still open) ask for, and the number of open ones with the one, if it is one."""
        per = waits.groupBy(*by).agg(F.max("least").alias("least"), F.count("to").alias("n"), F.max("to").alias("next"),
                                     F.max(F.when(F.col("to").isNotNull(), F.col("d"))).alias("far"))
        n = F.coalesce("n", F.lit(0))
        return cut_lineage(nodes.join(per, by, "left").select(
            *by, "turn", F.greatest("place", "least").alias("place"), n.alias("open"), "next", "far",
            F.coalesce(F.col("least") > F.col("place"), F.lit(False)).alias("moved"),
            ((F.col("open") > 0) & (n == 0)).alias("closed")))

    waits = cut_lineage(waits)
    nodes = raised(own.select(*by, "turn", F.col("turn").alias("place"), F.lit(0).alias("open")), waits)
    while True:
        to = nodes.select("conv_id", F.col("call_id").alias("to"), "place", "open", "next", "far")
        met = waits.where("to is not null").select(*by, "to", "d").join(to, ["conv_id", "to"]).select(
            *by, (F.col("place") + F.col("d")).alias("least"),
            F.when(F.col("open") == 1, F.col("next")).when(F.col("open") > 1, F.col("to")).alias("to"),
            F.when(F.col("open") == 1, F.least(F.col("d") + F.col("far"), F.lit(FAR))).otherwise(F.col("d")).alias("d"))
        waits = cut_lineage(met.groupBy(*by, "to").agg(F.max("least").alias("least"), F.max("d").alias("d")))
        nodes = raised(nodes.select(*by, "turn", "place", "open"), waits)
        moved, closed = nodes.agg(F.bool_or("moved"), F.bool_or("closed")).first()
        if not moved or not closed:
            break
    cyclic = F.lit(bool(moved)) & (F.col("open") > 0)
    return nodes.select(*by, F.when(cyclic, F.col("turn")).otherwise(F.col("place")).alias("place"), cyclic.alias("cyclic"))


def format_chat(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """(conv_id, place, kind, turn, call_id, linked, errors, json) of every row."""
    rows = messages.select("conv_id", F.col("turn").cast("long"), F.col("kind").cast("string"),
                           F.col("call_id").cast("string"), F.col("name").cast("string"), F.col("body").cast("string"))
    rows = rows.withColumn("call_id", F.when(F.col("kind").isin("call", "result"), F.col("call_id")))
    # one row per identifier and kind: the earliest stands for all
    named = rows.where(F.col("kind").isin("call", "result") & F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()) \
        .groupBy("conv_id", "call_id").agg(
            F.min(F.when(F.col("kind") == "call", F.struct("turn", "body"))).alias("call"),
            F.min(F.when(F.col("kind") == "result", F.struct("turn", "body"))).alias("result"),
            F.count_if(F.col("kind") == "call").alias("calls"), F.count_if(F.col("kind") == "result").alias("results"))
    named = cut_lineage(named.select("conv_id", "call_id", "calls", "results", F.col("call.turn").alias("turn"),
                                     F.col("call.body").alias("body"), F.col("result.turn").alias("end"))
                        .withColumn("waits", _waits(F.col("body"))).drop("body"))
    placed = places(named.where("calls > 0"))
    links = named.select("conv_id", "call_id", "calls", "results").join(placed, ["conv_id", "call_id"], "left")
    # only rows with an identifier are exchanged: a conversation's plain messages would all share one key
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    known = rows.where(whole).join(links, ["conv_id", "call_id"]).unionByName(
        rows.where(~whole), allowMissingColumns=True)
    none = F.array().cast("array<string>")
    is_call, is_result = F.col("kind") == "call", F.col("kind") == "result"
    named_ = F.col("calls").isNotNull()
    errors = F.array_compact(F.array(
        F.when((is_call | is_result) & ~named_, F.lit("no identifier")),
        F.when(is_call & (F.col("calls") > 1) | is_result & (F.col("results") > 1), F.lit("repeated")),
        F.when(is_call & named_ & (F.col("results") == 0), F.lit("no result")),
        F.when(is_result & named_ & (F.col("calls") == 0), F.lit("no call")),
        F.when(is_call & F.col("cyclic"), F.lit("cyclic"))))
    errors = F.concat(errors, F.when(is_call, argument_errors(F.col("name"), F.col("body"), schemas)).otherwise(none))
    turn = F.coalesce("turn", F.lit(0))
    parsed = F.when(is_call, F.try_parse_json("body"))
    # keys in code point order; the arguments' own keys are sorted by the variant type
    written = F.to_json(F.struct(
        parsed.alias("arguments"), "call_id", F.when(~is_call | parsed.isNull(), F.col("body")).alias("content"),
        "kind", "name", F.col("turn")))
    return known.select(
        "conv_id", F.when(is_call | is_result, F.greatest(turn, "place")).otherwise(turn).alias("place"), "kind", "turn",
        "call_id", F.coalesce((F.col("calls") > 0) & (F.col("results") > 0), F.lit(False)).alias("linked"),
        F.concat_ws("; ", errors).alias("errors"), written.alias("json"))


#: Schemas of the query's tools.
TOOLS = {
    "search": {"query": ("string", True), "words": ("integer", True), "after": ("string", False)},
    "lookup": {"query": ("string", True), "words": ("number", True), "exact": ("boolean", True), "after": ("string", False)},
    "note": {"query": ("string", True), "after": ("string", False)},
}


def derived(conversations: DataFrame) -> DataFrame:
    """Tool use derived from plain conversations: every turn is a message; an
    assistant's turn also calls a tool with its whole text, a user's turn after
    the first is the result of the call in the turn before. Calls wait for the
    assistant's turn before; in every eighth turn for the next one instead."""
    text = F.coalesce(F.col("text"), F.lit(""))
    turn, role = F.col("turn"), F.col("role")
    name = F.element_at(F.array(F.lit("search"), F.lit("lookup"), F.lit("note")), (turn % 3).cast("int") + 1)
    words = F.regexp_count(text, F.lit(r"\S+"))
    after = F.when(turn % 8 == 1, turn + 2).when(turn > (turn % 8 == 3).cast("int") * 2 + 1, turn - 2 - (turn % 8 == 3).cast("int") * 2)
    arguments = F.to_json(F.struct(
        text.alias("query"), F.when(turn % 3 < 2, words).alias("words"), F.when(turn % 6 == 1, F.lit(True)).alias("exact"),
        F.when(after.isNotNull(), F.concat(F.lit("call_"), after)).alias("after")))
    empty = F.lit(None).cast("string")
    base = conversations.where("turn is not null")
    return conversations.select("conv_id", "turn", F.lit("message").alias("kind"), empty.alias("call_id"),
                                role.alias("name"), F.col("text").alias("body")) \
        .unionByName(base.where("role = 'assistant'").select(
            "conv_id", "turn", F.lit("call").alias("kind"), F.concat(F.lit("call_"), turn).alias("call_id"),
            name.alias("name"), arguments.alias("body"))) \
        .unionByName(base.where("role = 'user' and turn > 0").select(
            "conv_id", "turn", F.lit("result").alias("kind"), F.concat(F.lit("call_"), turn - 1).alias("call_id"),
            empty.alias("name"), F.col("text").alias("body")))
