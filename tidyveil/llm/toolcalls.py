"""Tool calls in conversations: calls linked to results, ordered, checked against schemas, written as canonical JSON.

Messages are rows. An assistant's message may be JSON with ``tool_calls`` (id, name, arguments, and ``needs``: the ids whose
results it uses), a tool's message JSON with ``tool_call_id`` and ``content``. Everything is built of column
expressions, aggregates and joins. Nothing is gathered by conversation, so one conversation may hold most of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidyveil.llm.common import stored, text_of

#: Types that arguments can be declared with, and what Spark calls the types of parsed values.
TYPES = {
    "string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "DECIMAL"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",),
}

_CALLS = "tool_calls array<struct<id:string,name:string,arguments:string,needs:array<string>>>"
_RESULT = "tool_call_id string, content string"


def _json_text(text: Column) -> Column:
    """Text that can be a JSON object; anything else is plain text."""
    return F.when(text.rlike(r"^\s*\{"), text)


def calls_of(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """A row for each call: conv, turn, position, call_id, name, arguments, needs and how many calls its message has."""
    parsed = messages.filter(F.col(role) == "assistant").select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.from_json(_json_text(text_of(text)), _CALLS)["tool_calls"].alias("calls")
    )
    # Where a call stands among those of its message.
    listed = F.transform("calls", lambda c, i: F.struct(
        i.cast("int").alias("position"), c["id"].alias("call_id"), c["name"].alias("name"), c["arguments"].alias("arguments"),
        F.coalesce(c["needs"], F.array().cast("array<string>")).alias("needs"),
    ))
    return parsed.select("conv", "turn", F.explode(listed).alias("c")).select("conv", "turn", "c.*")


def results_of(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """A row for each result: conv, turn, call_id, content."""
    parsed = F.from_json(_json_text(text_of(text)), _RESULT)
    return messages.filter(F.col(role) == "tool").select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), parsed["tool_call_id"].alias("call_id"), parsed["content"].alias("content")
    )


def problems_of(name: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Sorted complaints about the arguments of a call: array<string>."""
    value = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(value).startswith("OBJECT")
    names = F.json_object_keys(F.when(is_object, F.to_json(value)))
    out = F.array(F.concat(F.lit("unknown tool "), F.coalesce(name, F.lit("NULL"))))
    for tool, schema in schemas.items():
        checks = []
        for field, (kind, required) in schema.items():
            part = F.try_variant_get(value, f'$["{field}"]', "variant")
            found = F.schema_of_variant(part)
            fits = F.lit(False)
            for prefix in TYPES[kind]:
                fits = fits | found.startswith(prefix)
            absent = ~F.array_contains(names, field)
            checks.append(F.when(absent, F.lit(f"missing {field}") if required else F.lit(None)).when(~F.coalesce(fits, F.lit(False)), F.lit(f"{field} is not {kind}")))
        declared = F.array(*[F.lit(f) for f in schema]).cast("array<string>")
        unknown = F.transform(F.array_except(names, declared), lambda f: F.concat(F.lit("undeclared "), f))
        told = F.array_sort(F.concat(F.filter(F.array(*checks).cast("array<string>"), lambda c: c.isNotNull()), unknown))
        out = F.when(name == tool, F.when(value.isNull() | ~is_object, F.array(F.lit("arguments are no object"))).otherwise(told)).otherwise(out)
    return out


def _size(df: DataFrame) -> tuple:
    """Tells whether a round changed anything: rows, and a sum over their hashes."""
    return tuple(df.agg(F.count(F.lit(1)), F.expr(f"sum(cast(xxhash64({', '.join(df.columns)}) AS decimal(20)))")).first())


def topological_order(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Places and levels of calls that need others. ``edges`` has conv, node and needed, both structs (turn, position).

    A call's place is its own, or that of the last call that it needs, directly or not, if that stands later: then calls of
    different place are in order. Places are carried over edges in rounds until nothing changes; they travel no further than
    the edges that point forwards reach. Calls of one place get levels: those that need none of it have 0, and each round
    gives the next level to those whose needs all have one. What needs itself over others never gets one.

    Returns (conv, node, place) of the calls that have another place than their own, and (conv, node, level) of those that
    need a call of their place; level is missing where a circle is in the way. Every round is stored.
    """
    edges = stored(edges.distinct(), "needs")
    on = lambda a, b: F.col("conv").eqNullSafe(F.col("__conv")) & F.col(a).eqNullSafe(F.col(b))
    places = stored(edges.filter(F.col("needed") > F.col("node")).groupBy("conv", "node").agg(F.max("needed").alias("place")), "places")
    before, now = None, _size(places)
    while now != before and now[0]:
        known = places.select(F.col("conv").alias("__conv"), F.col("node").alias("__node"), "place")
        carried = edges.join(known, on("needed", "__node")).filter(F.col("place") > F.col("node")).select("conv", "node", "place")
        places = stored(places.unionByName(carried).groupBy("conv", "node").agg(F.max("place").alias("place")), "places")
        before, now = now, _size(places)

    known = places.select(F.col("conv").alias("__conv"), F.col("node").alias("__node"), "place")
    own = edges.join(known, on("node", "__node"), "left").select("conv", "node", "needed", F.coalesce("place", "node").alias("own"))
    both = own.join(known, on("needed", "__node"), "left").filter(F.col("own").eqNullSafe(F.coalesce("place", "needed")))
    left = stored(both.select("conv", "node", "needed"), "left")
    levels, level, before, now = None, 0, None, _size(left)
    while now != before and now[0]:
        level += 1
        waiting = left.select(F.col("conv").alias("__conv"), F.col("node").alias("__node")).distinct()
        rest = stored(left.join(waiting, on("needed", "__node"), "left_semi"), "left")
        still = rest.select(F.col("conv").alias("__conv"), F.col("node").alias("__node")).distinct()
        done = left.select("conv", "node").distinct().join(still, on("node", "__node"), "left_anti").withColumn("level", F.lit(level))
        levels = stored(done if levels is None else levels.unionByName(done), "levels")
        left, before, now = rest, now, _size(rest)
    circle = left.select("conv", "node").distinct().withColumn("level", F.lit(None).cast("int"))
    return places, circle if levels is None else levels.unionByName(circle)


def link_tool_calls(
    messages: DataFrame,
    schemas: dict[str, dict[str, tuple[str, bool]]],
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """A row for each call, and for each result without one. (at_turn, at_position, level, turn, position) is a topological order.

    Columns: conv, turn, position, call_id, name, state, problems (array<string>), result_turn, at_turn, at_position, level,
    canonical. state is ``answered``, ``unanswered``, ``repeated`` (an earlier call of the conversation has the id; that one
    gets the result) or ``orphan`` (a result whose call does not come before it). Of several results for a call the first
    counts, the others are orphans. A call that needs one that stands later is put at that one's place (at_turn,
    at_position) and has a level above it. problems lists what is wrong with the arguments, ``needs unknown`` for needed ids
    that no call has, and ``in a cycle`` for calls that need themselves over others, or such a call of their place: they
    have no level. canonical is JSON with sorted keys and no blanks; arguments that are no JSON stay a string.

    ``schemas``: tool to argument to (type, required). Messages that are no such JSON hold no calls. A missing id links
    to nothing. Repeated rows repeat calls. Other columns are not read. Messages are parsed once.
    """
    calls = stored(calls_of(messages, conv, turn, role, text), "calls")
    results = stored(results_of(messages, conv, turn, role, text), "results")
    place = F.struct("turn", "position")
    firsts = calls.filter(F.col("call_id").isNotNull()).groupBy("conv", "call_id").agg(F.min(place).alias("first"))
    of = firsts.select(F.col("conv").alias("__conv"), F.col("call_id").alias("__id"), "first")
    # Results count from the first one after the call on; those of equal turn and content are told apart by nothing.
    given = results.join(of, (F.col("conv") == F.col("__conv")) & (F.col("call_id") == F.col("__id")) & (F.col("turn") > F.col("first.turn")))
    first_result = given.groupBy("__conv", "__id").agg(F.min(F.struct("turn", "content")).alias("result"))
    linked = of.join(first_result, ["__conv", "__id"], "left")
    own = calls.join(linked, (F.col("conv") == F.col("__conv")) & (F.col("call_id") == F.col("__id")), "left").drop("__conv", "__id")

    # Edges go to the first call of the needed id.
    edges = calls.filter(F.size("needs") > 0).select("conv", place.alias("node"), F.explode(F.array_distinct("needs")).alias("needed_id"))
    first = firsts.select(F.col("conv").alias("__conv"), F.col("call_id").alias("__id"), F.col("first").alias("needed"))
    found = stored(edges.join(first, (F.col("conv") == F.col("__conv")) & (F.col("needed_id") == F.col("__id")), "left").select("conv", "node", "needed"), "edges")
    places, levels = topological_order(found.filter("needed IS NOT NULL"))
    facts = [
        found.groupBy("conv", "node").agg(F.max(F.col("needed").isNull()).alias("unknown")).filter("unknown"),
        places,
        levels.select("conv", "node", F.coalesce("level", F.lit(-1)).alias("level")),
    ]
    checked = own.withColumn("node", place)
    for fact in facts:
        fact = fact.withColumnsRenamed({"conv": "__conv", "node": "__node"})
        checked = checked.join(fact, F.col("conv").eqNullSafe(F.col("__conv")) & F.col("node").eqNullSafe(F.col("__node")), "left").drop("__conv", "__node")
    in_circle = F.coalesce(F.col("level") < 0, F.lit(False))
    problems = F.concat(
        problems_of(F.col("name"), F.col("arguments"), schemas),
        F.filter(F.array(F.when(in_circle, F.lit("in a cycle")), F.when(F.col("unknown"), F.lit("needs unknown"))), lambda p: p.isNotNull()),
    )
    at = F.coalesce("place", "node")
    order = [at["turn"].alias("at_turn"), at["position"].alias("at_position"), F.when(~in_circle, F.coalesce("level", F.lit(0))).alias("level")]
    is_first = F.col("first").isNull() | place.eqNullSafe(F.col("first"))
    result = F.when(is_first, F.col("result"))
    state = F.when(~is_first, "repeated").when(result.isNull(), "unanswered").otherwise("answered")
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.to_json(F.struct(F.col("arguments").alias("a"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("arguments").alias("a")))) - 6))
    rows = checked.select("conv", "turn", "position", "call_id", "name", state.alias("state"), problems.alias("problems"), result["turn"].alias("result_turn"), *order, arguments.alias("__arguments"), result["content"].alias("content"))

    taken = linked.filter("result IS NOT NULL").select(F.col("__conv").alias("__c"), F.col("__id").alias("__i"), "result")
    orphans = results.join(
        taken, (F.col("conv") == F.col("__c")) & (F.col("call_id") == F.col("__i")) & F.struct("turn", "content").eqNullSafe(F.col("result")), "left_anti"
    ).select(
        "conv", "turn", F.lit(0).alias("position"), "call_id", F.lit(None).cast("string").alias("name"), F.lit("orphan").alias("state"),
        F.array().cast("array<string>").alias("problems"), F.col("turn").alias("result_turn"),
        F.col("turn").alias("at_turn"), F.lit(0).alias("at_position"), F.lit(0).alias("level"), F.lit(None).cast("string").alias("__arguments"), "content",
    )
    return rows.unionByName(orphans).select(
        "conv", "turn", "position", "call_id", "name", "state", "problems", "result_turn", "at_turn", "at_position", "level", _canonical().alias("canonical")
    )


def _canonical() -> Column:
    """Keys in order, those without a value left out; strings escaped as JSON."""
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6)
    parts = [
        F.when(F.col("__arguments").isNotNull(), F.concat(F.lit('"arguments":'), F.col("__arguments"))),
        F.when(F.col("content").isNotNull(), F.concat(F.lit('"content":'), quoted("content"))),
        F.when(F.col("call_id").isNotNull(), F.concat(F.lit('"id":'), quoted("call_id"))),
        F.when(F.col("name").isNotNull(), F.concat(F.lit('"name":'), quoted("name"))),
        F.concat(F.lit('"state":'), quoted("state")),
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


#: The tools of the query below, and what their arguments have to be.
SCHEMAS = {
    "reply": {"text": ("string", True), "limit": ("integer", True), "style": ("string", False)},
    "summarize": {"text": ("string", True), "ratio": ("number", True)},
    "look_up": {"turn": ("integer", True)},
}


def as_messages(conversations: DataFrame) -> DataFrame:
    """Plain conversations as tool calls: each user's turn is a message with calls, the first of which the assistant's next turn answers.

    Turns of at least 200 characters ask to summarize, others to reply; that call needs the one two turns before. Every
    fifth limit is a string, so that there is something to complain about. Two of three messages also look something up, in
    a call that the first needs though it stands behind it, or that needs the first; in every seventh both need each
    other. Every eleventh first call needs that of the next message, and other lookups that of the next message.
    """
    id_of = lambda turn, more="": F.concat(F.lit("call_"), turn.cast("string"), F.lit(more))
    turn, text = F.col("turn"), text_of("text")
    odd = turn % 5 == 4
    reply = F.when(odd, F.to_json(F.struct(text.alias("text"), (turn + 1).cast("string").alias("limit")))).otherwise(
        F.to_json(F.struct(text.alias("text"), (turn + 1).cast("long").alias("limit")))
    )
    long = F.length(text) >= 200
    arguments = F.when(long, F.to_json(F.struct(text.alias("text"), F.lit(0.5).alias("ratio")))).otherwise(reply)
    listed = lambda *ids: F.filter(F.array(*ids), lambda i: i.isNotNull())
    needs = listed(F.when(turn >= 3, id_of(turn - 2)), F.when((turn % 3 == 1) | (turn % 7 == 5), id_of(turn, "_more")), F.when(turn % 11 == 3, id_of(turn + 2)))
    first = F.struct(id_of(turn).alias("id"), F.when(long, "summarize").otherwise("reply").alias("name"), arguments.alias("arguments"), needs.alias("needs"))
    other_needs = listed(F.when((turn % 3 == 2) | (turn % 7 == 5), id_of(turn)), F.when(turn % 11 == 7, id_of(turn + 2, "_more")))
    other = F.struct(
        id_of(turn, "_more").alias("id"), F.lit("look_up").alias("name"), F.to_json(F.struct(turn.cast("long").alias("turn"))).alias("arguments"), other_needs.alias("needs")
    )
    call = F.when(turn % 3 != 0, F.array(first, other)).otherwise(F.array(first))
    user = F.to_json(F.struct(call.alias("tool_calls")))
    answer = F.to_json(F.struct(id_of(turn - 1).alias("tool_call_id"), text.alias("content")))
    return conversations.filter(F.col("role").isin("user", "assistant")).select(
        "conv_id", "turn", F.when(F.col("role") == "user", "assistant").otherwise("tool").alias("role"),
        F.when(F.col("role") == "user", user).otherwise(answer).alias("text"),
    )


def calls_by_conversation(conversations: DataFrame) -> DataFrame:
    """The tool calls of all conversations, linked, checked and as canonical JSON."""
    found = link_tool_calls(as_messages(conversations), SCHEMAS)
    return found.select(
        F.col("conv").alias("conv_id"), "turn", "position", "call_id", "name", "state", F.array_join("problems", "; ").alias("problems"), "result_turn",
        "at_turn", "at_position", "level", "canonical"
    )


SQL = """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations WHERE role IN ('user', 'assistant')),
calls AS (
  SELECT conv_id, turn, 0 AS position, 'call_' || turn AS call_id, CASE WHEN len(text) >= 200 THEN 'summarize' ELSE 'reply' END AS name,
         CASE WHEN len(text) >= 200 THEN '{"ratio":0.5,"text":' || to_json(text) || '}'
              WHEN turn % 5 = 4 THEN '{"limit":"' || (turn + 1) || '","text":' || to_json(text) || '}'
              ELSE '{"limit":' || (turn + 1) || ',"text":' || to_json(text) || '}' END AS arguments
  FROM t WHERE role = 'user'
  UNION ALL
  SELECT conv_id, turn, 1, 'call_' || turn || '_more', 'look_up', '{"turn":' || turn || '}' FROM t WHERE role = 'user' AND turn % 3 <> 0),
wanted AS (
  SELECT conv_id, turn, position, unnest(CASE position
    WHEN 0 THEN [CASE WHEN turn >= 3 THEN 'call_' || (turn - 2) END, CASE WHEN turn % 3 = 1 OR turn % 7 = 5 THEN 'call_' || turn || '_more' END,
                 CASE WHEN turn % 11 = 3 THEN 'call_' || (turn + 2) END]
    ELSE [CASE WHEN turn % 3 = 2 OR turn % 7 = 5 THEN 'call_' || turn END, CASE WHEN turn % 11 = 7 THEN 'call_' || (turn + 2) || '_more' END] END) AS id
  FROM calls),
ids AS (SELECT conv_id, call_id, min((turn, position)) AS spot FROM calls GROUP BY ALL),
edges AS (
  SELECT DISTINCT w.conv_id, (w.turn, w.position) AS node, i.spot AS needed FROM wanted w LEFT JOIN ids i ON i.conv_id = w.conv_id AND i.call_id = w.id
  WHERE w.id IS NOT NULL),
carried AS (
  SELECT conv_id, node, needed AS place FROM edges WHERE needed > node
  UNION
  SELECT e.conv_id, e.node, c.place FROM edges e JOIN carried c ON c.conv_id = e.conv_id AND c.node = e.needed WHERE c.place > e.node),
places AS (SELECT conv_id, node, max(place) AS place FROM carried GROUP BY ALL),
near AS (
  SELECT e.conv_id, e.node, e.needed FROM edges e LEFT JOIN places a ON a.conv_id = e.conv_id AND a.node = e.node
  LEFT JOIN places b ON b.conv_id = e.conv_id AND b.node = e.needed
  WHERE e.needed IS NOT NULL AND coalesce(a.place, e.node) = coalesce(b.place, e.needed)),
reached AS (
  SELECT conv_id, node, needed FROM near
  UNION
  SELECT r.conv_id, r.node, n.needed FROM reached r JOIN near n ON n.conv_id = r.conv_id AND n.node = r.needed),
circles AS (SELECT conv_id, node FROM reached WHERE node = needed),
stuck AS (
  SELECT conv_id, node FROM circles
  UNION SELECT r.conv_id, r.node FROM reached r JOIN circles c ON c.conv_id = r.conv_id AND c.node = r.needed),
steps AS (
  SELECT DISTINCT n.conv_id, n.node, 1 AS level FROM near n WHERE NOT EXISTS (SELECT 1 FROM stuck s WHERE s.conv_id = n.conv_id AND s.node = n.node)
  UNION
  SELECT n.conv_id, n.node, s.level + 1 FROM near n JOIN steps s ON s.conv_id = n.conv_id AND s.node = n.needed
  WHERE NOT EXISTS (SELECT 1 FROM stuck x WHERE x.conv_id = n.conv_id AND x.node = n.node)),
levels AS (SELECT conv_id, node, max(level) AS level FROM steps GROUP BY ALL),
answers AS (SELECT conv_id, turn, min(text) AS content FROM t WHERE role = 'assistant' GROUP BY ALL),
results AS (SELECT conv_id, turn, text AS content FROM t WHERE role = 'assistant'),
unknown AS (SELECT DISTINCT conv_id, node FROM edges WHERE needed IS NULL),
rows AS (
  SELECT c.conv_id, c.turn, c.position, c.call_id, c.name, CASE WHEN a.turn IS NULL OR c.position = 1 THEN 'unanswered' ELSE 'answered' END AS state,
         concat_ws('; ', CASE WHEN c.name = 'reply' AND c.turn % 5 = 4 THEN 'limit is not integer' END,
                   CASE WHEN s.node IS NOT NULL THEN 'in a cycle' END, CASE WHEN u.node IS NOT NULL THEN 'needs unknown' END) AS problems,
         CASE WHEN c.position = 0 THEN a.turn END AS result_turn, coalesce(p.place, (c.turn, c.position)) AS spot,
         CASE WHEN s.node IS NULL THEN coalesce(l.level, 0) END AS level, c.arguments, CASE WHEN c.position = 0 THEN a.content END AS content
  FROM calls c LEFT JOIN answers a ON a.conv_id = c.conv_id AND a.turn = c.turn + 1
  LEFT JOIN places p ON p.conv_id = c.conv_id AND p.node = (c.turn, c.position)
  LEFT JOIN (SELECT DISTINCT * FROM stuck) s ON s.conv_id = c.conv_id AND s.node = (c.turn, c.position)
  LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.node = (c.turn, c.position)
  LEFT JOIN unknown u ON u.conv_id = c.conv_id AND u.node = (c.turn, c.position)
  UNION ALL
  SELECT r.conv_id, r.turn, 0, 'call_' || (r.turn - 1), NULL, 'orphan', '', r.turn, (r.turn, 0), 0, NULL, r.content
  FROM results r LEFT JOIN ids i ON i.conv_id = r.conv_id AND i.call_id = 'call_' || (r.turn - 1)
  LEFT JOIN answers a ON a.conv_id = r.conv_id AND a.turn = r.turn AND a.content = r.content
  WHERE i.call_id IS NULL OR a.turn IS NULL)
SELECT conv_id, turn, position, call_id, name, state, problems, result_turn, spot[1] AS at_turn, spot[2]::INTEGER AS at_position, level,
       '{' || concat_ws(',', '"arguments":' || arguments, '"content":' || to_json(content), '"id":' || to_json(call_id), '"name":' || to_json(name),
                        '"state":' || to_json(state)) || '}' AS canonical
FROM rows"""
