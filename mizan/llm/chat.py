"""Chat formatting: tool calls linked to results, ordered, validated and written as canonical JSON (operator 5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mizan.llm.common import Scratch, read

CALLS = "array<struct<id: string, name: string, arguments: string, after: array<string>>>"
#: Fixed schemas of the registered query: (tool, argument, type, required).
SCHEMAS = (("search", "query", "string", True), ("search", "limit", "integer", False), ("fetch", "url", "string", True), ("calculate", "expression", "string", True), ("calculate", "digits", "integer", False))


def parsed(text: Column) -> Column:
    """A message's JSON object, null if it is none (or names a key twice)."""
    return F.when(F.coalesce(text, F.lit("")).rlike(r"^\s*\{"), F.try_parse_json(text))


def tool_calls(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, call_id, name, arguments, after) of messages(conv_id, turn, role, text): the entries of
    `tool_calls` in assistants' JSON messages, {"tool_calls": [{"id", "name", "arguments": {...}, "after": [ids]}]}."""
    some = messages.filter("role = 'assistant'").withColumn("v", parsed(F.col("text"))).filter("v is not null")
    each = some.select("conv_id", "turn", F.posexplode(F.from_json(F.get_json_object(F.col("text"), "$.tool_calls"), CALLS)).alias("pos", "c"))
    return each.select("conv_id", "turn", "pos", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.coalesce("c.after", F.expr("cast(array() as array<string>)")).alias("after"))


def tool_results(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, call_id) of messages of role tool, {"tool_call_id": id, "content": ...}."""
    some = messages.filter("role = 'tool'").withColumn("v", parsed(F.col("text"))).filter("v is not null")
    return some.select("conv_id", F.col("turn").alias("result_turn"), F.get_json_object("text", "$.tool_call_id").alias("call_id")).filter("call_id is not null")


def faults(spark: SparkSession, calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(conv_id, turn, pos, faults): what is wrong with each call's arguments by schemas(name, field, type, required);
    calls without fault are left out. Types are JSON's: string, integer, number, boolean, object, array."""
    key = ["conv_id", "turn", "pos"]
    some = calls.withColumn("v", F.try_parse_json("arguments"))
    given = spark.sql("SELECT c.conv_id, c.turn, c.pos, c.name, e.key AS field, schema_of_variant(e.value) AS kind FROM {calls} c, LATERAL variant_explode(c.v) e WHERE schema_of_variant(c.v) LIKE 'OBJECT%'", calls=some)
    kind = F.when(F.col("kind") == "STRING", "string").when(F.col("kind") == "BIGINT", "integer").when(F.col("kind") == "BOOLEAN", "boolean").when(F.col("kind").startswith("OBJECT"), "object").when(F.col("kind").startswith("ARRAY"), "array").when(F.col("kind") == "VOID", "null").otherwise("number")
    given = given.withColumn("kind", kind)
    declared = schemas.select("name").distinct().withColumn("declared", F.lit(True))
    checked = given.join(declared, "name").join(schemas, ["name", "field"], "left")
    right = (F.col("kind") == F.col("type")) | ((F.col("type") == "number") & (F.col("kind") == "integer"))
    wrong = checked.select(*key, F.when(F.col("type").isNull(), F.concat(F.lit("unknown "), "field")).when(~right, F.concat("field", F.lit(" is no "), "type")).alias("f"))
    wanted = some.select(*key, "name").join(schemas.filter("required"), "name")
    missing = wanted.join(given.select(*key, "field"), [*key, "field"], "left_anti").select(*key, F.concat(F.lit("missing "), "field").alias("f"))
    odd = some.join(declared, "name", "left").select(*key, F.when(F.col("declared").isNull(), F.lit("unknown tool")).when(F.col("v").isNull() | ~F.schema_of_variant("v").startswith("OBJECT"), F.lit("arguments are no object")).alias("f"))
    every = wrong.unionByName(missing).unionByName(odd).filter("f is not null")
    return every.groupBy(*key).agg(F.array_sort(F.collect_set("f")).alias("faults"))


def levels(calls: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that wait for none, else one more than the latest call they wait for. Calls
    on a cycle, or behind one, have no level; ids that name no call of the conversation are not waited for.

    Calls that wait for one other are first hung on the nearest call above them that waits for none or for several, by
    doubling their steps: a chain takes as many joins as its length has binary digits. The others are placed once as many
    of their edges are placed as they have, one join for each of them on a path. Both go on until no row is new."""
    key = ["conv_id", "call_id"]
    nodes = calls.filter("call_id is not null").select(*key).distinct()
    edges = calls.select(*key, F.explode("after").alias("before")).distinct()
    edges = scratch.keep(edges.join(nodes.withColumnRenamed("call_id", "before"), ["conv_id", "before"]), "edges")
    need = edges.groupBy(*key).agg(F.count("*").alias("need"), F.min("before").alias("top"))
    # up: the call, the one it hangs on, the steps between them, and whether that one is an end
    kinds = nodes.join(need, key, "left").withColumn("need", F.coalesce("need", F.lit(0)))
    ends = scratch.keep(kinds.filter("need <> 1").select(*key, "need"), "ends")
    up = scratch.keep(kinds.filter("need = 1").select(*key, "top", F.lit(1).alias("steps")).join(ends.select("conv_id", F.col("call_id").alias("top"), F.lit(True).alias("ended")), ["conv_id", "top"], "left").select(*key, "top", "steps", F.coalesce("ended", F.lit(False)).alias("ended")), "up-0")
    rounds, open_ = 0, None
    while True:
        above = up.select("conv_id", F.col("call_id").alias("top"), F.col("top").alias("__top"), F.col("steps").alias("__steps"), F.col("ended").alias("__ended"))
        # a call that hangs on an end keeps it; no end is in `above`
        next_ = up.join(above, ["conv_id", "top"], "left").select(*key, F.coalesce("__top", "top").alias("top"), (F.col("steps") + F.coalesce("__steps", F.lit(0))).alias("steps"), (F.col("ended") | F.coalesce("__ended", F.lit(False))).alias("ended"))
        rounds += 1
        up, seen = scratch.observed(next_, f"up-{rounds}", F.count_if(~F.col("ended")).alias("n"))
        if seen["n"] == 0 or seen["n"] == open_:  # what stays open is on a cycle or hangs on one
            break
        open_ = seen["n"]
    hung = up.filter("ended").select(*key, "top", "steps")
    # of the edges of calls that wait for several: (call, end above it, steps to that end)
    several = ends.filter("need > 1")
    direct = edges.join(several, key).select(*key, "before")
    way = hung.select("conv_id", F.col("call_id").alias("before"), "top", "steps")
    links = direct.join(way, ["conv_id", "before"], "left").join(ends.select("conv_id", F.col("call_id").alias("before"), F.lit(True).alias("is_end")), ["conv_id", "before"], "left")
    links = scratch.keep(links.filter("top is not null or is_end").select(*key, F.coalesce("top", "before").alias("top"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "links")
    fresh = scratch.keep(ends.filter("need = 0").select(*key, F.lit(0).alias("level"), F.lit(0).cast("long").alias("need")), "level-0")
    waiting = several.select(*key, F.lit(None).cast("int").alias("level"), F.col("need").cast("long").alias("need"))
    names, n = ["level-0"], 0
    while True:
        # need counts the edges still open, level is the largest level met
        met = links.join(fresh.select("conv_id", F.col("call_id").alias("top"), F.col("level").alias("__at")), ["conv_id", "top"]).groupBy(*key).agg(F.count("*").alias("met"), F.max(F.col("__at") + F.col("steps")).alias("at"))
        state = waiting.join(met, key, "left").select(*key, F.greatest("level", "at").alias("level"), (F.col("need") - F.coalesce("met", F.lit(0))).alias("need"))
        n += 1
        state, seen = scratch.observed(state, f"level-{n}", F.count_if(F.col("need") == 0).alias("n"))
        if not seen["n"]:
            break
        names.append(f"level-{n}")
        fresh, waiting = state.filter("need = 0"), state.filter("need > 0")
    placed = scratch.spark.read.schema(state.schema).parquet(*[scratch.path(x) for x in names]).filter("need = 0").select(*key, "level")
    below = hung.join(placed.withColumnRenamed("call_id", "top"), ["conv_id", "top"]).select(*key, (F.col("level") + F.col("steps")).alias("level"))
    return placed.unionByName(below)


def link(spark: SparkSession, messages: DataFrame, schemas: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages, calls) of messages(conv_id, turn, role, text).

    messages: conv_id, turn, role, json (canonical: sorted keys, no spaces; a JSON text is canonical JSON itself, any
    other is {"content", "role"}), n_calls, answers (the call a tool message answers). calls: conv_id, turn, pos,
    call_id, name, arguments (canonical), level, result_turn (the first result after the call), status (linked, no
    result, repeated id, no id) and faults. Calls and results meet in a hash join on (conv_id, id). Rows stay rows: no
    conversation is gathered, however long.

    Null role or text: null in the JSON is left out. Text that is no JSON object (or names a key twice), empty or long, is
    content, and so is every text of other roles than assistant and tool. A result before its call, or without one,
    answers nothing. Rows alike in all four columns: each is formatted, their calls count once. An id used by two calls is
    status `repeated id` and takes the first result after it. Rows without a conv_id are formatted; their calls link to
    nothing. No schemas: arguments are not checked. Other columns are dropped. An empty table: no rows.
    """
    tmp = Scratch(spark, "chat")
    base = messages.select("conv_id", "turn", "role", "text")
    once = base.filter("role in ('assistant', 'tool')").distinct()
    calls = tmp.keep(tool_calls(once).distinct(), "calls")
    results = tmp.keep(tool_results(once), "results")
    uses = calls.groupBy("conv_id", "call_id").agg(F.count("*").alias("uses"), F.min("turn").alias("first_turn"))
    pair = calls.join(results, ["conv_id", "call_id"]).filter("result_turn > turn").groupBy("conv_id", "turn", "pos").agg(F.min("result_turn").alias("result_turn"))
    out = calls.join(levels(calls, tmp), ["conv_id", "call_id"], "left").join(uses, ["conv_id", "call_id"], "left").join(pair, ["conv_id", "turn", "pos"], "left")
    status = F.when(F.col("call_id").isNull(), "no id").when(F.col("uses") > 1, "repeated id").when(F.col("result_turn").isNull(), "no result").otherwise("linked")
    none = F.expr("cast(array() as array<string>)")
    if schemas is not None:
        out = out.join(faults(spark, calls, schemas), ["conv_id", "turn", "pos"], "left").withColumn("faults", F.coalesce("faults", none))
    else:
        out = out.withColumn("faults", none)
    canonical = F.coalesce(F.to_json(F.try_parse_json("arguments")), F.col("arguments"))
    out = out.select("conv_id", "turn", "pos", "call_id", "name", canonical.alias("arguments"), "level", "result_turn", status.alias("status"), "faults")
    per = calls.groupBy("conv_id", "turn").agg(F.count("*").alias("n_calls")).withColumn("role", F.lit("assistant"))
    answer = results.join(uses.filter("call_id is not null"), ["conv_id", "call_id"]).filter("result_turn > first_turn")
    answer = answer.groupBy("conv_id", F.col("result_turn").alias("turn")).agg(F.min("call_id").alias("answers")).withColumn("role", F.lit("tool"))
    plain = F.to_json(F.struct(F.col("text").alias("content"), "role"))
    own = F.when(F.col("role").isin("assistant", "tool"), F.to_json(parsed(F.col("text"))))
    shown = base.withColumn("json", F.coalesce(own, plain)).drop("text")
    shown = shown.join(per, ["conv_id", "turn", "role"], "left").join(answer, ["conv_id", "turn", "role"], "left")
    return shown.select("conv_id", "turn", "role", "json", F.coalesce("n_calls", F.lit(0)).cast("long").alias("n_calls"), "answers"), out


#: The registered query's conversations hold no calls, so it makes them from each message: fixed rules, of which some give
#: wrong arguments, repeated or missing ids, missing results and cycles. These expressions are Spark's and DuckDB's alike.
ROLE = "CASE WHEN role = 'user' AND turn > 0 THEN 'tool' ELSE role END"
ANSWERED = "'c' || (turn - 1) || CASE WHEN conv_id % 2 = 0 THEN 'b' ELSE 'a' END"
_SEARCH = """CASE (conv_id + turn) % 5 WHEN 0 THEN '{"limit":"' || turn || '","query":"q' || conv_id || '"}' WHEN 1 THEN '{"limit":' || turn || '}'
 WHEN 2 THEN '{"more":null,"query":"q' || conv_id || '"}' ELSE '{"limit":' || turn || ',"query":"q' || conv_id || '"}' END"""
_OTHER = """CASE conv_id % 3 WHEN 0 THEN '"arguments":{"digits":2,"expression":"1+' || turn || '"},' WHEN 1 THEN '"arguments":{"url":' || conv_id || '},' ELSE '"arguments":[' || turn || '],' END"""
_ID = """CASE WHEN conv_id % 13 = 5 THEN '' WHEN conv_id % 7 = 3 THEN '"id":"b",' ELSE '"id":"c' || turn || 'b",' END"""
CALLING = f"""'{{"tool_calls":[{{"after":["c' || (turn - 2) || 'b"' || CASE WHEN conv_id % 11 = 0 THEN ',"c' || turn || 'b"' ELSE '' END || '],"arguments":' || {_SEARCH} || ',"id":"c' || turn || 'a","name":"search"}},{{"after":["c' || turn || 'a"],' ||
 {_OTHER} || {_ID} || '"name":"' || CASE conv_id % 3 WHEN 0 THEN 'calculate' WHEN 1 THEN 'fetch' ELSE 'mystery' END || '"}}]}}'"""


def with_calls(conversations: DataFrame) -> DataFrame:
    """Assistants' messages as tool calls, users' later ones as tools' results that carry their text."""
    result = f"to_json(named_struct('content', text, 'tool_call_id', {ANSWERED}))"
    text = f"CASE WHEN role = 'assistant' THEN {CALLING} WHEN role = 'user' AND turn > 0 THEN {result} ELSE text END"
    return conversations.selectExpr("conv_id", "turn", f"{ROLE} AS role", f"{text} AS text")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every message (kind `message`) and every call (kind `call`) of conversations with tool calls."""
    schemas = spark.createDataFrame(SCHEMAS, "name string, field string, type string, required boolean")
    shown, calls = link(spark, with_calls(read(spark, sf_dir, "conversations")), schemas)
    every = shown.withColumn("kind", F.lit("message")).unionByName(calls.withColumns({"kind": F.lit("call"), "faults": F.array_join("faults", "; ")}), allowMissingColumns=True)
    return every.select("kind", "conv_id", "turn", "role", "json", "n_calls", "answers", F.col("pos").cast("long").alias("pos"), "call_id", "name", "arguments", F.col("level").cast("long").alias("level"), "result_turn", "status", "faults")


OP5_SQL = f"""
WITH RECURSIVE m AS (SELECT conv_id, turn, {ROLE} AS role, CASE WHEN role = 'assistant' THEN {CALLING} WHEN role = 'user' AND turn > 0 THEN CAST(json_object('content', text, 'tool_call_id', {ANSWERED}) AS VARCHAR) ELSE text END AS text FROM conversations),
l AS (SELECT conv_id, turn, unnest(range(0, CAST(json_array_length(text, '$.tool_calls') AS BIGINT))) AS pos, text FROM m WHERE role = 'assistant'),
c AS (SELECT conv_id, turn, pos, text ->> ('$.tool_calls[' || pos || '].id') AS call_id, text ->> ('$.tool_calls[' || pos || '].name') AS name, CAST(text -> ('$.tool_calls[' || pos || '].arguments') AS VARCHAR) AS arguments, from_json(text -> ('$.tool_calls[' || pos || '].after'), '["VARCHAR"]') AS after FROM l),
r AS (SELECT conv_id, turn AS result_turn, text ->> '$.tool_call_id' AS call_id FROM m WHERE role = 'tool'),
nodes AS (SELECT DISTINCT conv_id, call_id FROM c WHERE call_id IS NOT NULL),
e AS (SELECT DISTINCT x.conv_id, x.call_id, x.b AS before FROM (SELECT conv_id, call_id, unnest(after) AS b FROM c WHERE call_id IS NOT NULL) x JOIN nodes n ON n.conv_id = x.conv_id AND n.call_id = x.b),
reach AS (SELECT conv_id, call_id, before FROM e UNION SELECT x.conv_id, x.call_id, e.before FROM reach x JOIN e ON e.conv_id = x.conv_id AND e.call_id = x.before),
cyclic AS (SELECT DISTINCT conv_id, call_id FROM reach WHERE call_id = before),
bad AS (SELECT * FROM cyclic UNION SELECT x.conv_id, x.call_id FROM reach x JOIN cyclic y ON y.conv_id = x.conv_id AND y.call_id = x.before),
good AS (SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.conv_id = e.conv_id AND bad.call_id = e.call_id)),
up AS (SELECT conv_id, call_id, before, 1 AS steps FROM good UNION SELECT up.conv_id, up.call_id, good.before, steps + 1 FROM up JOIN good ON good.conv_id = up.conv_id AND good.call_id = up.before),
lv AS (SELECT n.conv_id, n.call_id, coalesce(max(steps), 0) AS level FROM nodes n LEFT JOIN up USING (conv_id, call_id) WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.conv_id = n.conv_id AND bad.call_id = n.call_id) GROUP BY 1, 2),
uses AS (SELECT conv_id, call_id, count(*) AS uses, min(turn) AS first_turn FROM c WHERE call_id IS NOT NULL GROUP BY 1, 2),
pair AS (SELECT c.conv_id, c.turn, c.pos, min(result_turn) AS result_turn FROM c JOIN r ON r.conv_id = c.conv_id AND r.call_id = c.call_id AND result_turn > c.turn GROUP BY 1, 2, 3),
s(name, field, type, required) AS (VALUES {", ".join(f"('{a}', '{b}', '{c}', {d})" for a, b, c, d in SCHEMAS)}),
given AS (SELECT conv_id, turn, pos, name, arguments, unnest(json_keys(arguments)) AS field FROM c WHERE json_type(arguments) = 'OBJECT'),
typed AS (SELECT *, CASE json_type(arguments -> ('$.' || field)) WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'number' WHEN 'NULL' THEN 'null' ELSE lower(json_type(arguments -> ('$.' || field))) END AS kind FROM given),
f AS (SELECT conv_id, turn, pos, CASE WHEN s.type IS NULL THEN 'unknown ' || t.field WHEN s.type <> t.kind AND NOT (s.type = 'number' AND t.kind = 'integer') THEN t.field || ' is no ' || s.type END AS f FROM typed t LEFT JOIN s ON s.name = t.name AND s.field = t.field WHERE t.name IN (SELECT name FROM s)
 UNION ALL SELECT conv_id, turn, pos, 'missing ' || s.field FROM c JOIN s ON s.name = c.name AND s.required WHERE NOT EXISTS (SELECT 1 FROM given g WHERE g.conv_id = c.conv_id AND g.turn = c.turn AND g.pos = c.pos AND g.field = s.field)
 UNION ALL SELECT conv_id, turn, pos, CASE WHEN name NOT IN (SELECT name FROM s) THEN 'unknown tool' WHEN json_type(arguments) <> 'OBJECT' THEN 'arguments are no object' END FROM c),
wrong AS (SELECT conv_id, turn, pos, string_agg(DISTINCT f, '; ' ORDER BY f) AS faults FROM f WHERE f IS NOT NULL GROUP BY 1, 2, 3),
answer AS (SELECT r.conv_id, r.result_turn AS turn, min(r.call_id) AS answers FROM r JOIN uses USING (conv_id, call_id) WHERE result_turn > first_turn GROUP BY 1, 2)
SELECT 'message' AS kind, m.conv_id, m.turn, m.role, CASE WHEN m.role IN ('assistant', 'tool') THEN text ELSE CAST(json_object('content', text, 'role', m.role) AS VARCHAR) END AS json, coalesce(k.n, 0) AS n_calls, a.answers, CAST(NULL AS BIGINT) AS pos, NULL AS call_id, NULL AS name, NULL AS arguments, CAST(NULL AS BIGINT) AS level, CAST(NULL AS BIGINT) AS result_turn, NULL AS status, NULL AS faults
FROM m LEFT JOIN (SELECT conv_id, turn, count(*) AS n FROM c GROUP BY 1, 2) k ON k.conv_id = m.conv_id AND k.turn = m.turn AND m.role = 'assistant' LEFT JOIN answer a ON a.conv_id = m.conv_id AND a.turn = m.turn AND m.role = 'tool'
UNION ALL
SELECT 'call', c.conv_id, c.turn, NULL, NULL, NULL, NULL, c.pos, c.call_id, c.name, c.arguments, level, result_turn, CASE WHEN c.call_id IS NULL THEN 'no id' WHEN uses > 1 THEN 'repeated id' WHEN result_turn IS NULL THEN 'no result' ELSE 'linked' END, coalesce(faults, '')
FROM c LEFT JOIN lv USING (conv_id, call_id) LEFT JOIN uses USING (conv_id, call_id) LEFT JOIN pair USING (conv_id, turn, pos) LEFT JOIN wrong USING (conv_id, turn, pos)
"""
