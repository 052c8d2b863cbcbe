"""Chat formatting: links tool calls to results, orders them, validates arguments, writes canonical JSON.

Everything is DataFrame functions; there is no Python on the executors. Events are rows with conv_id,
turn, role, kind ('call', 'result' or 'message'), call_id, name, arguments (a map from names to canonical JSON
values), content and, optionally, needs (identifiers of the calls whose results an event's call waits for). Calls and
results meet by a hash join of (conv_id, call_id): each side is joined with the other side reduced to one row for
each identifier, so a repeated identifier makes no rows, and no conversation is gathered in one task.

The order is topological. Every event has a place of its own, twice its turn, and one more for a result. A result
depends on its call, and a call on the results of those that it needs. ``position`` is the longest path that leads to
an event: the largest of its own place and one more than the position of each event that it depends on. An event that
moves back in this way does not hold up others of later turns, unless they depend on it. Paths are followed along the
links in rounds, all conversations at once, one round for each step of the longest chain of needs. Events on a cycle
of needs, and those behind one, have no such order: they keep their own place and are marked ``cyclic``.

Canonical JSON has sorted keys at every depth, no white space and numbers in one form; a string stays a string,
whatever it looks like. JSON with a repeated key or that is not valid is no tool traffic but a message.

Defined cases: a null conversation, turn or identifier links to nothing and a null turn has no position;
of several calls with one identifier the earliest counts as the call, and all its results link to it; needs
of a call that does not exist, or that has no result, are no dependency; a null text is an absent argument or content;
a text of any length is kept whole; repeated rows give repeated rows; an empty table gives no rows; other columns of
the input are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textio

#: The schema of a tool: argument name to type and limits. Other arguments are errors.
Schema = dict[str, dict]

REPLY_SCHEMAS: dict[str, Schema] = {
    "reply": {
        "prompt": {"type": "string", "required": True, "min": 1, "max": 1000},
        "polite": {"type": "boolean", "required": True},
        "options": {"type": "object"},
        "turn": {"type": "integer", "required": True, "min": 0},
    },
    "configure": {"instructions": {"type": "string", "required": True, "min": 1}, "turn": {"type": "integer", "required": True, "min": 0}},
}
_TYPES = {"string": '^"', "integer": "^-?[0-9]+$", "number": "^-?[0-9]", "boolean": "^(true|false)$", "object": r"^\{", "array": r"^\[", "null": "^null$"}


def quote(text: Column) -> Column:
    """A JSON string of the text; null stays null."""
    one = F.to_json(F.array(text))
    return F.when(text.isNotNull(), F.substring(one, F.lit(2), F.length(one) - 2))


def tidy(json: Column) -> Column:
    """The JSON text in canonical form; null if it is not valid."""
    return F.to_json(F.try_parse_json(json))


def from_json_texts(conversations: DataFrame) -> DataFrame:
    """Events of turns whose text is {"tool_call": {"id", "name", "arguments", "needs"}} or {"tool_result": {"id", "content"}}; others are messages."""
    v = F.try_parse_json(F.when(F.trim("text").startswith("{"), F.col("text")))
    part = lambda path, kind: F.try_variant_get(v, path, kind)
    call, result = F.coalesce(part("$.tool_call", "map<string,variant>").isNotNull(), F.lit(False)), F.coalesce(part("$.tool_result", "map<string,variant>").isNotNull(), F.lit(False))
    content = part("$.tool_result.content", "variant")
    text_of = F.when(F.schema_of_variant(content) == "STRING", part("$.tool_result.content", "string")).otherwise(F.to_json(content))
    return conversations.select(
        "conv_id",
        "turn",
        "role",
        F.when(call, "call").when(result, "result").otherwise("message").alias("kind"),
        F.when(call, part("$.tool_call.id", "string")).when(result, part("$.tool_result.id", "string")).alias("call_id"),
        F.when(call, part("$.tool_call.name", "string")).alias("name"),
        F.when(call, F.transform_values(part("$.tool_call.arguments", "map<string,variant>"), lambda _, x: F.coalesce(F.to_json(x), F.lit("null")))).alias("arguments"),
        F.when(call, F.lit(None)).when(result, text_of).otherwise(F.col("text")).alias("content"),
        F.when(call, part("$.tool_call.needs", "array<string>")).alias("needs"),
    )


def as_replies(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool traffic. A user's turn calls ``reply`` and a system turn ``configure``; the calls of
    four turns share an identifier, so that some repeat. An assistant's turn is a result of the call before it, but
    every fourth turn is one of the call after it, which may come later or be missing. Other roles are messages."""
    named = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), (F.floor(turn / 4.0) * 4).cast("string"))
    whole = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    call, result = F.coalesce(F.col("role").isin("user", "system"), F.lit(False)), F.coalesce(F.col("role") == "assistant", F.lit(False))
    user = F.col("role") == "user"
    options = tidy(F.when(user & F.col("turn").isNotNull(), F.concat(F.lit('{"style" : "plain", "depth" : '), F.col("turn").cast("string"), F.lit("}"))))
    polite = F.when(user & F.col("text").isNotNull(), F.when(F.col("text").endswith("."), "true").otherwise("false"))
    what = F.when(user, "prompt").otherwise("instructions")
    arguments = F.map_from_arrays(F.array(what, F.lit("turn"), F.lit("options"), F.lit("polite")), F.array(quote(F.col("text")), F.col("turn").cast("string"), options, polite))
    answered = F.when(F.col("turn") % 4 == 3, F.col("turn") + 1).otherwise(F.col("turn") - 1)
    return conversations.select(
        "conv_id",
        "turn",
        "role",
        F.when(call, "call").when(result, "result").otherwise("message").alias("kind"),
        F.when(whole & call, named(F.col("turn"))).when(whole & result, named(answered)).alias("call_id"),
        F.when(call, F.when(user, "reply").otherwise("configure")).alias("name"),
        F.when(call, F.map_filter(arguments, lambda _, v: v.isNotNull())).alias("arguments"),
        F.when(~call, F.col("text")).alias("content"),
    )


def violations(schemas: dict[str, Schema]) -> Column:
    """Sorted errors of a call's arguments against its tool's schema; an unknown tool is an error of its own."""
    arguments = F.coalesce(F.col("arguments"), F.create_map().cast("map<string,string>"))
    out = F.array(F.lit("unknown tool"))
    for tool, schema in schemas.items():
        others = F.array_except(F.map_keys(arguments), F.array(*map(F.lit, schema)))
        errors = [F.transform(others, lambda k: F.concat(k, F.lit(": unexpected")))]
        for name, rule in schema.items():
            v = F.element_at(arguments, F.lit(name))
            size = F.length(F.get_json_object(F.concat(F.lit('{"v":'), v, F.lit("}")), "$.v")) if rule["type"] == "string" else F.try_to_number(v, F.lit("S999999999999999999"))
            checks = [(F.lit(bool(rule.get("required"))) & v.isNull(), "missing"), (~v.rlike(_TYPES[rule["type"]]), f"not {rule['type']}")]
            if "min" in rule:
                checks.append((v.rlike(_TYPES[rule["type"]]) & (size < rule["min"]), "too small"))
            if "max" in rule:
                checks.append((v.rlike(_TYPES[rule["type"]]) & (size > rule["max"]), "too large"))
            errors.append(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(f"{name}: {what}")) for c, what in checks)), lambda e: e.isNotNull()))
        out = F.when(F.col("name") == tool, F.array_sort(F.concat(*errors))).otherwise(out)
    return out


def canonical() -> Column:
    """The event as JSON with sorted keys and no white space; absent values are left out."""
    arguments = F.coalesce(F.col("arguments"), F.create_map().cast("map<string,string>"))
    inner = F.array_join(F.transform(F.array_sort(F.map_keys(arguments)), lambda k: F.concat(quote(k), F.lit(":"), F.element_at(arguments, k))), ",")
    members = F.array(
        F.when(F.col("kind") == "call", F.concat(F.lit('"arguments":{'), inner, F.lit("}"))),
        F.concat(F.lit('"content":'), quote(F.col("content"))),
        F.concat(F.lit('"id":'), quote(F.col("call_id"))),
        F.concat(F.lit('"kind":'), quote(F.col("kind"))),
        F.concat(F.lit('"name":'), quote(F.col("name"))),
        F.concat(F.lit('"role":'), quote(F.col("role"))),
        F.concat(F.lit('"turn":'), F.col("turn").cast("string")),
    )
    return F.concat(F.lit("{"), F.array_join(members, ","), F.lit("}"))


def call_positions(sides: DataFrame) -> DataFrame:
    """conv_id, call_id, call_at, cyclic: the position of every call of sides (conv_id, call_id, call_turn, needs,
    result_turn), along the links of needs."""
    key = ["conv_id", "call_id"]
    calls = textio.cut(sides.where("call_turn is not null"))
    results = sides.where("result_turn is not null").select("conv_id", F.col("call_id").alias("need"), (2 * F.col("result_turn") + 1).alias("result_at"), F.col("call_turn").isNotNull().alias("waits"))
    waits = calls.where(F.size("needs") > 0).select(*key, F.explode(F.array_distinct("needs")).alias("need"))
    links = textio.cut(waits.join(results, ["conv_id", "need"]))
    known = calls.join(links.select(*key).distinct(), key, "left_anti").select(*key, (2 * F.col("call_turn")).alias("call_at"))
    open_ = calls.join(links.select(*key).distinct(), key, "left_semi").select(*key, (2 * F.col("call_turn")).alias("own"))
    rounds = 0
    while rounds == 0 or found:
        # Whose needs all have a position now, by the join on the calls that they name.
        at = known.select("conv_id", F.col("call_id").alias("need"), F.col("call_at").alias("need_at"))
        met = links.join(at, ["conv_id", "need"], "left").withColumn("ready", ~F.col("waits") | F.col("need_at").isNotNull())
        after = F.greatest("result_at", F.col("need_at") + 1) + 1
        due = met.groupBy(*key).agg(F.min("ready").alias("ready"), F.max(after).alias("after")).where("ready")
        new = textio.cut(open_.join(due, key).join(known.select(*key), key, "left_anti").select(*key, F.greatest("own", "after").alias("call_at")))
        found, rounds = not new.isEmpty(), rounds + 1
        known = textio.cut(known.unionByName(new))
    never = open_.join(known.select(*key), key, "left_anti").select(*key, F.col("own").alias("call_at"), F.lit(True).alias("cyclic"))
    return known.withColumn("cyclic", F.lit(False)).unionByName(never)


def format_events(events: DataFrame, schemas: dict[str, Schema]) -> DataFrame:
    """One row for each event: link, topological position, errors and canonical JSON."""
    key = ["conv_id", "call_id"]
    named = events.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
    waits = "needs" in events.columns
    needs = [F.min_by("needs", "turn").alias("needs")] if waits else []
    calls = named.where("kind = 'call'").groupBy(*key).agg(F.min("turn").alias("call_turn"), *needs)
    answers = named.where("kind = 'result'").groupBy(*key).agg(F.min("turn").alias("result_turn"))
    # Both reduced sides in one table, so that the events are dealt out once.
    sides = calls.hint("shuffle_hash").join(answers.hint("shuffle_hash"), key, "full")
    if waits:
        sides = textio.cut(sides)
        sides = sides.join(call_positions(sides), key, "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    else:
        # Without needs no path is longer than from a call to its result.
        sides = sides.withColumns({"call_at": 2 * F.col("call_turn"), "cyclic": F.lit(False)})
    joined = events.join(sides.drop("needs").hint("shuffle_hash"), key, "left")
    own = 2 * F.col("turn")
    late = F.when(F.col("kind") == "result", F.greatest(own + 1, F.col("call_at") + 1)).when((F.col("kind") == "call") & (F.col("turn") == F.col("call_turn")), F.coalesce("call_at", own)).otherwise(own)
    errors = F.when(F.col("kind") == "call", violations(schemas))
    return joined.select(
        "conv_id",
        "turn",
        "role",
        "kind",
        "call_id",
        ((F.col("kind") == "call") & F.col("result_turn").isNotNull() | (F.col("kind") == "result") & F.col("call_turn").isNotNull()).alias("linked"),
        F.when(F.col("turn").isNotNull(), late).cast("long").alias("position"),
        F.coalesce(F.col("cyclic") & (F.col("kind") != "message"), F.lit(False)).alias("cyclic"),
        F.coalesce(F.size(errors) == 0, F.lit(True)).alias("valid"),
        F.array_join(errors, "; ").alias("errors"),
        canonical().alias("canonical"),
    )


def op4_tool_chat(spark, sf_dir: str) -> DataFrame:
    turns = textio.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return format_events(as_replies(turns), REPLY_SCHEMAS)


OP4_SQL = """
WITH e AS (
  SELECT conv_id, turn, role, text,
    CASE WHEN role IN ('user', 'system') THEN 'call' WHEN role = 'assistant' THEN 'result' ELSE 'message' END AS kind,
    CASE WHEN role IN ('user', 'system') THEN turn WHEN role = 'assistant' THEN CASE WHEN turn % 4 = 3 THEN turn + 1 ELSE turn - 1 END END AS of_turn,
    CASE role WHEN 'user' THEN 'prompt' WHEN 'system' THEN 'instructions' END AS what
  FROM conversations),
i AS (SELECT *, CASE WHEN conv_id IS NOT NULL AND of_turn IS NOT NULL THEN conv_id::VARCHAR || ':' || (floor(of_turn / 4.0) * 4)::BIGINT::VARCHAR END AS call_id FROM e),
c AS (SELECT call_id, min(turn) AS call_turn FROM i WHERE kind = 'call' GROUP BY 1),
r AS (SELECT call_id, min(turn) AS result_turn FROM i WHERE kind = 'result' GROUP BY 1),
x AS (
  SELECT i.*, call_turn, result_turn,
    CASE WHEN kind = 'call' THEN concat_ws('; ',
      CASE WHEN role = 'system' THEN CASE WHEN text IS NULL THEN 'instructions: missing' WHEN length(text) < 1 THEN 'instructions: too small' END END,
      CASE WHEN role = 'user' AND text IS NULL THEN 'polite: missing' END,
      CASE WHEN role = 'user' THEN CASE WHEN text IS NULL THEN 'prompt: missing' WHEN length(text) < 1 THEN 'prompt: too small' WHEN length(text) > 1000 THEN 'prompt: too large' END END,
      CASE WHEN turn IS NULL THEN 'turn: missing' WHEN turn < 0 THEN 'turn: too small' END) END AS errors
  FROM i LEFT JOIN c USING (call_id) LEFT JOIN r USING (call_id))
SELECT conv_id, turn, role, kind, call_id,
  (kind = 'call' AND result_turn IS NOT NULL) OR (kind = 'result' AND call_turn IS NOT NULL) AS linked,
  (CASE WHEN turn IS NOT NULL THEN CASE WHEN kind = 'result' THEN 2 * greatest(turn, coalesce(call_turn, turn)) + 1 ELSE 2 * turn END END)::BIGINT AS position,
  false AS cyclic, coalesce(errors, '') = '' AS valid, errors,
  '{' || concat_ws(',',
    CASE WHEN kind = 'call' THEN '"arguments":{' || concat_ws(',',
      CASE WHEN role = 'system' THEN '"instructions":' || to_json(text)::VARCHAR END,
      CASE WHEN role = 'user' THEN '"options":{"depth":' || turn::VARCHAR || ',"style":"plain"}' END,
      CASE WHEN role = 'user' AND text IS NOT NULL THEN '"polite":' || CASE WHEN text LIKE '%.' THEN 'true' ELSE 'false' END END,
      CASE WHEN role = 'user' THEN '"prompt":' || to_json(text)::VARCHAR END,
      '"turn":' || turn::VARCHAR) || '}' END,
    CASE WHEN kind <> 'call' THEN '"content":' || to_json(text)::VARCHAR END,
    '"id":' || to_json(call_id)::VARCHAR, '"kind":"' || kind || '"',
    CASE role WHEN 'user' THEN '"name":"reply"' WHEN 'system' THEN '"name":"configure"' END,
    '"role":' || to_json(role)::VARCHAR, '"turn":' || turn::VARCHAR) || '}' AS canonical
FROM x
"""
