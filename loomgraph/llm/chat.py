"""Chat formatting with tool-call linking, in DataFrame operations only.

A message whose text is a JSON object with `tool_calls` (each with id, name and
arguments) makes calls; a message of role `tool` whose JSON has `tool_call_id`
is a result. Calls and results are hash-joined by conversation and identifier.
A result has one call and so one message before it: the links are chains, and
messages are ordered topologically by doubling along them. Their order is given
as a key, not as a running number, so no conversation is gathered in one task.
Arguments are validated against schemas, and each message becomes canonical JSON:
keys sorted, no blanks, absent fields left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._exchange import settle


def json_type(v: Column) -> Column:
    """The JSON schema type of a variant."""
    t = F.schema_of_variant(v)
    return F.when(t == "BIGINT", "integer").when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "number").when(t == "STRING", "string").when(t == "BOOLEAN", "boolean").when(t.startswith("OBJECT"), "object").when(t.startswith("ARRAY"), "array").otherwise("null")


def _parsed(messages: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    v = F.when(F.ltrim(text).startswith("{"), F.try_parse_json(text))
    rows = messages.select("mid", F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role"), F.col("text"), v.alias("v"))
    calls = F.try_variant_get("v", "$.tool_calls", "array<variant>")
    result = F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string"))
    rows = rows.select("mid", "conv_id", "turn", "role", "text", "v", calls.alias("calls"), result.alias("result_id"))
    content = F.when(F.col("calls").isNull() & F.col("result_id").isNull(), F.col("text")).otherwise(F.try_variant_get("v", "$.content", "string"))
    return rows.select("mid", "conv_id", "turn", "role", content.alias("content"), "calls", "result_id")


def numbered(messages: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with mid, a number for each row, settled so that each later reading gives the same."""
    return settle(messages.select("conv_id", "turn", "role", "text").withColumn("mid", F.monotonically_increasing_id()))


def tool_calls(messages: DataFrame) -> DataFrame:
    """(mid, conv_id, turn, ord, call_id, name, args) of numbered messages: a row for each call; args is a variant, null where it
    is no JSON."""
    calls = _parsed(messages).select("mid", "conv_id", "turn", F.posexplode("calls").alias("ord", "call"))
    given = F.try_variant_get("call", "$.arguments", "variant")
    args = F.when(F.schema_of_variant(given) == "STRING", F.try_parse_json(F.try_variant_get("call", "$.arguments", "string"))).otherwise(given)
    return calls.select("mid", "conv_id", "turn", "ord", F.try_variant_get("call", "$.id", "string").alias("call_id"), F.try_variant_get("call", "$.name", "string").alias("name"), args.alias("args"))


def validate_arguments(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with `errors`, the number of faults: an unknown tool, arguments that are no object, and parameters that are
    required and missing, unknown, or of another type. schemas: (name, param, type, required); a number may be an integer."""
    known = schemas.groupBy("name").agg(F.map_from_entries(F.collect_list(F.struct("param", F.struct("type", "required")))).alias("params"))
    rows = calls.join(known, "name", "left")
    is_object = F.coalesce(F.schema_of_variant("args").startswith("OBJECT"), F.lit(False))
    given = F.when(is_object, F.from_json(F.to_json("args"), "map<string,variant>"))
    required = F.map_keys(F.map_filter("params", lambda _, p: F.coalesce(p["required"], F.lit(False))))
    missing = F.size(F.array_except(required, F.map_keys(given)))
    kind = lambda k: F.element_at("params", k)["type"]
    wrong = F.size(F.filter(F.map_entries(given), lambda e: kind(e["key"]).isNull() | ~((json_type(e["value"]) == kind(e["key"])) | ((kind(e["key"]) == "number") & (json_type(e["value"]) == "integer")))))
    errors = F.when(F.col("params").isNull() | ~is_object, 1).otherwise(missing + wrong)
    return rows.select(*calls.columns, errors.cast("long").alias("errors"))


def ordered(links: DataFrame) -> DataFrame:
    """(mid, order_turn, order_step, cyclic) of links (mid, turn, before, before_turn): a message goes behind the one before it,
    which may itself be linked; with a later turn of its own it begins that turn's place, else it takes the next step in the
    other's. Links that run in a circle order nothing.

    A stretch of a chain is summed up by its largest turn, how many steps follow the message that has it, and its length; two
    stretches make one, so each round doubles them and a chain of n takes log2 n rounds."""
    one = links.select("mid", F.col("before").alias("up"), F.col("turn").alias("top"), F.lit(0).cast("long").alias("after"), F.lit(1).cast("long").alias("length"))
    ends = links.select(F.col("before").alias("mid"), F.col("before_turn").alias("top")).distinct().join(links.select("mid"), "mid", "left_anti")
    roots = ends.select("mid", F.lit(None).cast("long").alias("up"), "top", F.lit(0).cast("long").alias("after"), F.lit(1).cast("long").alias("length"))
    now = settle(one.unionByName(roots))
    n, reach = links.count(), 1
    while reach <= n and not now.where("up is not null").isEmpty():
        first = now.select(F.col("mid").alias("up"), F.col("up").alias("u"), F.col("top").alias("t"), F.col("after").alias("a"), F.col("length").alias("n"))
        both = now.join(first, "up", "left")
        later = F.col("t").isNull() | (F.col("top") > F.col("t"))
        now = settle(both.select("mid", F.col("u").alias("up"), F.greatest("top", "t").alias("top"), F.when(later, F.col("after")).otherwise(F.col("a") + F.col("length")).alias("after"), (F.col("length") + F.coalesce("n", F.lit(0))).alias("length")))
        reach *= 2
    return now.join(links.select("mid"), "mid", "left_semi").select("mid", F.col("top").alias("order_turn"), F.col("after").alias("order_step"), F.col("up").isNotNull().alias("cyclic"))


def format_chat(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """conv_id, turn, role, n_calls, n_answered, n_invalid, link, order_turn, order_step and json, a row for each message.

    link is `message`, `call`, `result`, `orphan` (a result whose call is not in its conversation) or `cycle` (a result that
    its call waits for in turn). Ordered by (order_turn, order_step) every result follows its call, however far that one has
    itself been moved; a result in a cycle keeps its turn. Of calls that repeat an identifier in a conversation the first by
    turn counts, of one turn the first row read. Rows that repeat a turn are messages of their own. Rows without conv_id or
    turn link with nothing. Texts that are null, empty or no JSON are plain messages. Other columns are ignored.
    """
    messages = numbered(messages)
    rows = _parsed(messages)
    calls = validate_arguments(tool_calls(messages), schemas)
    first = calls.where("conv_id is not null and turn is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "mid", "ord")).alias("at"))
    results = rows.where("conv_id is not null and turn is not null and result_id is not null").select("mid", "conv_id", "turn", F.col("result_id").alias("call_id"))
    answered = results.select("conv_id", "call_id").distinct().withColumn("answer", F.lit(1))
    counts = calls.join(answered, ["conv_id", "call_id"], "left").groupBy("mid").agg(F.count(F.lit(1)).alias("n_calls"), F.sum(F.coalesce("answer", F.lit(0))).alias("n_answered"), F.sum((F.col("errors") > 0).cast("long")).alias("n_invalid"))
    links = settle(results.join(first, ["conv_id", "call_id"]).select("mid", "turn", F.col("at.mid").alias("before"), F.col("at.turn").alias("before_turn")))
    out = rows.join(counts, "mid", "left").join(ordered(links), "mid", "left")
    link = F.when(F.col("result_id").isNotNull(), F.when(F.col("order_turn").isNull(), "orphan").when(F.col("cyclic"), "cycle").otherwise("result")).when(F.coalesce(F.size("calls"), F.lit(0)) > 0, "call").otherwise("message")
    arguments = lambda c: F.try_variant_get(c, "$.arguments", "variant")
    plain = F.transform("calls", lambda c: F.struct(F.when(F.schema_of_variant(arguments(c)) == "STRING", F.try_parse_json(F.try_variant_get(c, "$.arguments", "string"))).otherwise(arguments(c)).alias("arguments"), F.try_variant_get(c, "$.id", "string").alias("id"), F.try_variant_get(c, "$.name", "string").alias("name")))
    json = F.to_json(F.struct("content", "conv_id", "role", plain.alias("tool_calls"), F.col("result_id").alias("tool_call_id"), "turn"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    moved = F.col("order_turn").isNotNull() & ~F.coalesce("cyclic", F.lit(False))
    return out.select("conv_id", "turn", "role", number("n_calls"), number("n_answered"), number("n_invalid"), link.alias("link"), F.when(moved, F.col("order_turn")).otherwise(F.col("turn")).alias("order_turn"), F.when(moved, F.col("order_step")).otherwise(0).cast("long").alias("order_step"), json.alias("json"))
