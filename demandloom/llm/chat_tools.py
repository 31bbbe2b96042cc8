"""Chat formatting with tool-call linking.

DataFrame functions only.  Calls and results are hash-joined by conversation and call
identifier, put into topological order, their arguments validated against schemas,
and every message serialised as canonical JSON (keys sorted, no spaces), one line per
message, so that even the longest conversation is never gathered into one row: its
transcript is its lines in the order of (conv_id, order_turn, order_level, turn, part).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import Scratch, fresh

#: A schema: argument name -> (JSON type, required). Arguments not named are not allowed.
Schemas = dict[str, dict[str, tuple[str, bool]]]
_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
_INTEGER = r"^-?(0|[1-9][0-9]*)$"
#: Powers of ten up to 8 over few digits: exact as a decimal number of 38 digits.
_SMALL_POWER = r"^-?[0-9]{1,10}(\.[0-9]{1,10})?[eE][+-]?0*[0-8]$"


def quote(c: Column) -> Column:
    """A JSON string literal: what JSON must escape is escaped, all else stands as it is; null is null."""
    out = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    for code in range(32):
        char = chr(code)
        out = F.replace(out, F.lit(char), F.lit(json.dumps(char)[1:-1]))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), out, F.lit('"')))


def _object(pairs: dict[str, Column]) -> Column:
    """Canonical JSON object of already serialised values."""
    parts: list[Column] = []
    for k in sorted(pairs):
        parts += [F.lit(("," if parts else "{") + json.dumps(k) + ":"), pairs[k]]
    return F.concat(*parts, F.lit("}"))


def _number(v: Column) -> Column:
    """A JSON number without zeros at the end of its fraction, and in plain notation unless its power of ten is large."""
    plain = F.when(v.rlike(_SMALL_POWER), v.try_cast("decimal(38,18)").cast("string")).otherwise(v)
    plain = F.regexp_replace(F.regexp_replace(plain, r"^(-?[0-9]+)\.0*($|[eE])", "$1$2"), r"^(-?[0-9]+\.[0-9]*[1-9])0+($|[eE])", "$1$2")
    plain = F.regexp_replace(F.lower(plain), r"e([+]?|(-))0*([0-9])", "e$2$3")
    return F.when(plain == "-0", F.lit("0")).otherwise(plain)


def canonical(value: Column, kind: str) -> Column:
    """Canonical JSON of a text that is a value of this JSON type, null if it isn't.

    Numbers: see _number.  Objects and arrays are parsed and written again without
    spaces, names sorted; their numbers lose zeros at the end, and those in exponent
    notation are written as double precision.
    """
    if kind == "string":
        return F.when(value.isNotNull(), quote(value))
    if kind in ("number", "integer"):
        return F.when(value.rlike(_NUMBER if kind == "number" else _INTEGER), _number(value))
    if kind == "boolean":
        return F.when(value.isin("true", "false"), value)
    opening = {"object": "{", "array": "["}[kind]
    return F.when(F.ltrim(value).startswith(opening), F.to_json(F.try_parse_json(value)))


def canonical_arguments(arguments: Column, name: Column, schemas: Schemas) -> Column:
    """The arguments, a map from name to text, as canonical JSON: names sorted, values that
    are of their schema's type as such, all others (unknown tools and names, too) as strings."""

    def entries(schema: dict[str, tuple[str, bool]]) -> Column:
        def entry(e: Column) -> Column:
            out = quote(e["value"])
            for k, (kind, _) in sorted(schema.items()):
                if kind != "string":
                    out = F.when(e["key"] == k, F.coalesce(canonical(e["value"], kind), quote(e["value"]))).otherwise(out)
            return F.concat(quote(e["key"]), F.lit(":"), out)

        return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(arguments)), entry), ","), F.lit("}"))

    out = entries({})
    for tool, schema in sorted(schemas.items()):
        out = F.when(name == tool, entries(schema)).otherwise(out)
    return F.when(arguments.isNull(), F.lit("null")).otherwise(out)


def valid(arguments: Column, name: Column, schemas: Schemas) -> Column:
    """Whether the tool is known, all required arguments are there, none is unknown and each is a value of its type."""
    out = F.lit(False)
    for tool, schema in sorted(schemas.items()):
        ok = F.size(F.array_except(F.map_keys(arguments), F.array(*map(F.lit, schema)))) == 0
        for key, (kind, required) in schema.items():
            value = F.element_at(arguments, F.lit(key))
            ok = ok & F.when(value.isNull(), F.lit(not required)).otherwise(canonical(value, kind).isNotNull())
        out = F.when(name == tool, F.coalesce(ok, F.lit(False))).otherwise(out)
    return out


def _order(need: DataFrame, scratch: Scratch) -> DataFrame | None:
    """(conv_id, v, key, cyclic) for what v needs u (conv_id, v, u; places), or None if all need earlier places only.

    Path doubling: after k rounds keys cover all paths of fewer than 2**k steps, and the
    edges are the ends of paths of 2**k steps.  They run out unless there is a cycle: a
    path of as many steps as there are places meets one twice.
    """
    late = need.where("u >= v").select("conv_id").distinct()
    if not late.limit(1).count():
        return None
    edges = scratch.save(need.join(late, "conv_id", "left_semi").distinct())
    places = edges.select("conv_id", "v").union(edges.select("conv_id", "u")).distinct()
    state = scratch.save(places.select("conv_id", "v", F.struct(F.col("v.turn").alias("turn"), F.lit(0).cast("long").alias("level")).alias("key")))
    most = state.groupBy("conv_id").count().agg(F.max("count")).first()[0]
    steps = 1
    while True:
        behind = edges.join(state.select("conv_id", F.col("v").alias("u"), F.col("key").alias("k")), ["conv_id", "u"])
        behind = behind.groupBy("conv_id", "v").agg(F.max(F.struct(F.col("k.turn").alias("turn"), (F.col("k.level") + steps).alias("level"))).alias("least"))
        state = scratch.save(state.join(behind, ["conv_id", "v"], "left").select("conv_id", "v", F.greatest("key", "least").alias("key")))
        if steps >= most:
            break
        on = [F.col("x.conv_id") == F.col("y.conv_id"), F.col("x.u") == F.col("y.v")]
        edges = scratch.save(edges.alias("x").join(edges.alias("y"), on).select("x.conv_id", "x.v", "y.u").distinct())
        if not edges.limit(1).count():
            break
        steps *= 2
    endless = edges.select("conv_id", "v").distinct().withColumn("cyclic", F.lit(True))
    return state.join(endless, ["conv_id", "v"], "left")


def link(parts: DataFrame, schemas: Schemas) -> DataFrame:
    """Link and order parts of conversations.

    ``parts``: conv_id, turn, part (place in the turn), kind ('message', 'call' or
    'result'), role, text, call_id, name, arguments (map<string,string>), after (call
    ids whose results a call needs, array<string>).

    Adds linked (a call with a result, or a result with a call), duplicate (not the
    first call or result of its identifier; only first ones are linked),
    valid_arguments (calls), order_turn, order_level, cyclic and json.  A part stands
    at its own turn unless it needs a later one: results need their call, calls the
    results in ``after``.  It is then moved to just behind what it needs
    (order_level counts the steps behind it).  Parts that need themselves, or need
    such parts, are cyclic and stay where they were.  Null identifiers, conversations
    and places link with nothing.  Rows that repeat a place are all kept and treated
    alike.  An empty table gives an empty result.  Existing columns of the added
    names are replaced; all others pass through, whatever their names.
    """
    scratch = Scratch(parts.sparkSession)
    added = ["linked", "duplicate", "valid_arguments", "order_turn", "order_level", "cyclic", "json"]
    parts = parts.drop(*added)
    call_at, result_at, mate, key = fresh(parts.select(*parts.columns, *(F.lit(0).alias(c) for c in added)), "call_at", "result_at", "mate", "key")
    kind, here = F.col("kind"), F.struct("turn", "part")
    named = parts.where(F.col("call_id").isNotNull() & kind.isin("call", "result") & F.col("turn").isNotNull() & F.col("part").isNotNull()).select("conv_id", "call_id", "kind", here.alias("at"))
    ends = named.groupBy("conv_id", "call_id").agg(F.min(F.when(kind == "call", F.col("at"))).alias(call_at), F.min(F.when(kind == "result", F.col("at"))).alias(result_at))
    rows = parts.join(ends, ["conv_id", "call_id"], "left")
    own = F.when(kind == "call", F.col(call_at)).when(kind == "result", F.col(result_at))
    rows = rows.withColumns({"duplicate": F.coalesce(own != here, F.lit(False)), mate: F.when(kind == "call", F.col(result_at)).when(kind == "result", F.col(call_at))})
    rows = rows.withColumn("linked", F.coalesce((own == here) & F.col(mate).isNotNull(), F.lit(False)))
    need = rows.where("linked AND kind = 'result'").select("conv_id", here.alias("v"), F.col(mate).alias("u"))
    asked = rows.where((kind == "call") & (own == here) & F.col("after").isNotNull()).select("conv_id", here.alias("v"), F.explode("after").alias("call_id"))
    need = scratch.save(need.union(asked.join(ends.where(F.col(result_at).isNotNull()).select("conv_id", "call_id", F.col(result_at).alias("u")), ["conv_id", "call_id"]).select("conv_id", "v", "u")))
    moved = _order(need, scratch)
    if moved is None:
        rows = rows.withColumns({"order_turn": F.col("turn"), "order_level": F.lit(0).cast("long"), "cyclic": F.lit(False)})
    else:
        moved = moved.select("conv_id", F.col("v.turn").alias("turn"), F.col("v.part").alias("part"), F.when(F.col("cyclic").isNull(), F.col("key")).alias(key), "cyclic")
        rows = rows.join(moved, ["conv_id", "turn", "part"], "left")
        rows = rows.withColumns({"order_turn": F.coalesce(F.col(key)["turn"], F.col("turn")), "order_level": F.coalesce(F.col(key)["level"], F.lit(0)).cast("long"), "cyclic": F.coalesce("cyclic", F.lit(False))})
    call, args = kind == "call", F.col("arguments")
    call_json = _object({"id": quote(F.col("call_id")), "name": quote(F.col("name")), "arguments": canonical_arguments(args, F.col("name"), schemas)})
    line = F.when(call, _object({"role": quote(F.col("role")), "tool_call": call_json})).when(kind == "result", _object({"role": quote(F.col("role")), "tool_call_id": quote(F.col("call_id")), "content": quote(F.col("text"))})).otherwise(_object({"role": quote(F.col("role")), "content": quote(F.col("text"))}))
    return rows.withColumns({"valid_arguments": F.when(call, valid(args, F.col("name"), schemas)), "json": line}).select(*parts.columns, *added)


#: The tool that a plain conversation is read as: every user turn calls it, the next turn answers.
REPLY_SCHEMA: Schemas = {"reply": {"prompt": ("string", True), "turn": ("integer", True), "pages": ("number", True), "options": ("object", False)}}


def plain_parts(conversations: DataFrame) -> DataFrame:
    """Parts of conversations of plain text (conv_id, turn, role, text), which hold no tool calls of their own.

    A user turn is a call of ``reply``, an assistant turn the result of the turn
    before it; other roles are messages.  Calls are given what real ones have, by the
    MD5 of their text, so that every part of link() is at work: most need the result
    of the call before (no need if divisible by 3), some of the call that follows
    (by 7), which makes a cycle if that one needs this; some bear the identifier of
    the call before (by 11), and some have an argument of the wrong type (by 13).
    Null roles and texts are kept as null.
    """
    role, turn = F.col("role"), F.col("turn")
    user, code, size = role == "user", F.conv(F.substring(F.md5(F.coalesce("text", F.lit("")).cast("binary")), 1, 6), 16, 10).cast("long"), F.coalesce(F.char_length("text"), F.lit(0))
    kind = F.when(user, "call").when(role == "assistant", "result").otherwise("message")
    ident = F.when(user & (code % 11 == 0), turn - 2).when(user, turn).when(role == "assistant", turn - 1)
    number = F.when(code % 13 == 0, F.concat(F.lit("0"), turn.cast("string"))).otherwise(turn.cast("string"))
    pages = F.concat(F.floor(size / 2).cast("string"), F.when(size % 2 == 1, ".50").otherwise(".00"))
    options = F.concat(F.lit('{"size": '), size.cast("string"), F.lit(', "fields": [true, {"b": 1.50, "a": null}]}'))
    return conversations.select(
        "conv_id", "turn", F.lit(0).alias("part"), kind.alias("kind"), "role", "text", ident.cast("string").alias("call_id"),
        F.when(user, F.lit("reply")).alias("name"),
        F.when(user, F.create_map(F.lit("prompt"), F.col("text"), F.lit("turn"), number, F.lit("pages"), pages, F.lit("options"), options)).alias("arguments"),
        F.when(user & (code % 7 == 0), F.array((turn + 2).cast("string"))).when(user & (code % 3 != 0), F.array((turn - 2).cast("string"))).alias("after"),
    )


def from_conversations(conversations: DataFrame) -> DataFrame:
    """link() over plain conversations."""
    return link(plain_parts(conversations), REPLY_SCHEMA)
