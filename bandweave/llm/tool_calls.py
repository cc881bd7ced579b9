"""Tool-call linking with native expressions only.

Calls and results are joined by identifier. Calls are put in topological order of what they depend on, their arguments
validated against the tool's schema, and each call with its result is serialised as canonical JSON (keys sorted at every
depth, no white space), by way of the VARIANT type, whose objects are kept in key order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bandweave.llm.common import Scratch, materialize

#: tool -> field -> (type, required, limits); types: string, integer, number, boolean, array, object; limits (may be left
#: out): minimum, maximum, maxLength (code points), enum. Other fields are errors.
SCHEMAS = {
    "answer": {"text": ("string", True, {"maxLength": 1000}), "turn": ("integer", True, {"minimum": 1})},
    "setup": {"text": ("string", True, {"maxLength": 1000}), "turn": ("integer", True, {"maximum": 0})},
}
#: How VARIANT names the types.
_KINDS = {
    "string": "^STRING$",
    "integer": "^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL\\(\\d+,0\\))$",
    "number": "^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL\\(.*)$",
    "boolean": "^BOOLEAN$",
    "array": "^ARRAY<",
    "object": "^OBJECT<",
}


def _beyond(field: str, arguments: Column, limits: dict) -> Column:
    """What a field of the right type says against its limits, or null."""
    get = lambda kind: F.try_variant_get(arguments, f'$["{field}"]', kind)
    out = F.lit(None).cast("string")
    for name, limit in limits.items():
        if name == "minimum":
            bad, said = get("double") < limit, f"{field} is under {limit}"
        elif name == "maximum":
            bad, said = get("double") > limit, f"{field} is over {limit}"
        elif name == "maxLength":
            bad, said = F.char_length(get("string")) > limit, f"{field} is longer than {limit}"
        elif name == "enum":
            bad, said = ~get("string").isin(list(limit)), f"{field} is none of {', '.join(map(str, limit))}"
        else:
            raise ValueError(f"unknown limit {name}")
        out = F.coalesce(out, F.when(bad, said))
    return out


def argument_errors(tool: Column, arguments: Column, schemas=SCHEMAS) -> Column:
    """Sorted array of what is wrong with a VARIANT of arguments: not an object, unknown tool, or field by field."""
    whole = F.schema_of_variant(arguments)
    found = F.array(F.lit("unknown tool"))
    for name, fields in schemas.items():
        checks = []
        for field, (kind, required, *limits) in fields.items():
            value = F.variant_get(arguments, f'$["{field}"]', "variant")
            own = F.when(value.isNull(), F.lit(f"missing {field}" if required else None).cast("string"))
            own = own.when(~F.schema_of_variant(value).rlike(_KINDS[kind]), f"{field} is no {kind}")
            checks.append(own.otherwise(_beyond(field, arguments, dict(*limits))))
        keys = F.coalesce(F.json_object_keys(F.to_json(arguments)), F.array().cast("array<string>"))
        extra = F.transform(F.array_except(keys, F.array(*[F.lit(f) for f in fields])), lambda k: F.concat(F.lit("unknown "), k))
        errors = F.array_sort(F.concat(F.array_compact(F.array(*checks)), extra))
        found = F.when(tool == name, errors).otherwise(found)
    return F.when(arguments.isNull() | ~whole.rlike("^OBJECT<"), F.array(F.lit("arguments are no object"))).otherwise(found)


def dependency_levels(calls: DataFrame, edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """(call_id, level): 0 without dependencies, else one more than the highest of them; null on a cycle or behind one.

    calls (call_id), edges (call_id, needs). One round of joins by identifier for each level; calls deeper than max_rounds
    are an error. Edges to calls that are not there do not count. The result is a table.
    """
    with Scratch(calls.sparkSession) as scratch:
        calls = scratch.table(calls.select("call_id").distinct())
        there = calls.select(F.col("call_id").alias("needs"))
        edges = scratch.table(edges.select("call_id", "needs").distinct().join(there, "needs", "left_semi").join(calls, "call_id", "left_semi"))
        found = ready = scratch.table(calls.join(edges, "call_id", "left_anti").withColumn("level", F.lit(0)))
        for level in range(1, max_rounds):
            if edges.isEmpty() or ready.isEmpty():
                break
            left = scratch.table(edges.join(ready.select(F.col("call_id").alias("needs")), "needs", "left_anti"))
            ready = scratch.table(edges.select("call_id").distinct().join(left, "call_id", "left_anti").withColumn("level", F.lit(level)))
            found, edges = found.unionByName(ready), left
        else:
            if not edges.isEmpty() and not ready.isEmpty():
                raise RuntimeError(f"calls are deeper than {max_rounds} levels")
        rest = edges.select("call_id").distinct().withColumn("level", F.lit(None).cast("int"))
        return materialize(found.unionByName(rest))


def link(calls: DataFrame, results: DataFrame, schemas=SCHEMAS) -> DataFrame:
    """One row per call, and one per identifier of results that no call has.

    calls: conversation, position, call_id, tool, arguments (JSON text), needs (array of call ids); results: call_id,
    position, content. Result: conversation, position, call_id, tool, status (linked, unanswered, orphan), level, n_results,
    valid, errors, json.

    A result belongs to the call of its identifier; of several the first position (then the smallest content, null last)
    is taken and n_results counts them. Calls that repeat an identifier all get its result, and the level of all that they
    need together. A null identifier links with nothing and can be needed by none. level is the length of the longest
    path of needs below a call, so that rising levels are a topological order; it is null on a cycle and for what needs
    one. Arguments that are null or no JSON object are errors and are serialised as null. Other columns of calls and
    results are not passed on. Empty tables give an empty result.
    """
    calls = calls.select("conversation", "position", "call_id", "tool", "arguments", "needs")
    results = results.select("call_id", "position", "content").where("call_id IS NOT NULL")
    first = F.min(F.struct(F.col("position").isNull(), "position", F.col("content").isNull(), "content")).alias("first")
    grouped = materialize(results.groupBy("call_id").agg(first, F.count("*").alias("n_results")))
    grouped = grouped.select("call_id", F.col("first.content").alias("content"), "n_results")

    ids = calls.where("call_id IS NOT NULL")
    # a call without an identifier is known by its place and needs
    node = F.coalesce("call_id", F.concat(F.lit("\0"), F.to_json(F.struct("conversation", "position", "needs"))))
    nodes = calls.select(node.alias("call_id"), F.explode_outer("needs").alias("needs"))
    levels = dependency_levels(nodes.select("call_id"), nodes.where("needs IS NOT NULL"))
    linked = calls.withColumn("_node", node).join(levels.withColumnRenamed("call_id", "_node"), "_node").join(grouped, "call_id", "left")
    arguments = F.try_parse_json("arguments")
    errors = argument_errors(F.col("tool"), arguments, schemas)
    whole = F.when(F.schema_of_variant(arguments).rlike("^OBJECT<"), F.to_json(arguments))
    text = lambda c: F.coalesce(F.get(F.split(F.to_json(F.struct(F.col(c).alias("x"))), "^\\{\"x\":", 2), F.lit(1)), F.lit("null}"))
    quoted = lambda c: F.substring(text(c), F.lit(1), F.length(text(c)) - 1)
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(whole, F.lit("null")), F.lit(',"id":'), quoted("call_id"), F.lit(',"name":'), quoted("tool"), F.lit(',"result":'), quoted("content"), F.lit("}")
    )
    out = linked.select(
        "conversation", "position", "call_id", "tool",
        F.when(F.col("n_results").isNull(), "unanswered").otherwise("linked").alias("status"),
        "level", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        (F.size(errors) == 0).alias("valid"), F.array_join(errors, "; ").alias("errors"), json.alias("json"),
    )
    orphans = grouped.join(ids.select("call_id").distinct(), "call_id", "left_anti")
    kinds = dict(out.dtypes)
    fixed = {"status": F.lit("orphan"), "n_results": F.col("n_results"), "call_id": F.col("call_id"), "valid": F.lit(False), "errors": F.lit("no call"),
             "json": F.concat(F.lit('{"arguments":null,"id":'), quoted("call_id"), F.lit(',"name":null,"result":'), quoted("content"), F.lit("}"))}
    return out.unionByName(orphans.select(*[fixed.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in out.columns]))


def conversation_calls(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A chat table (conv_id, turn, role, text) as calls and results.

    Turns of users and systems are calls (tools answer and setup) that need the calls of the two turns before them; an
    assistant's turn is the result of the call of the turn before it.
    """
    ident = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    turn = F.col("turn").cast("long")
    asked = table.where(~F.col("role").eqNullSafe("assistant"))
    arguments = F.to_json(F.struct(F.col("turn").cast("long").alias("turn"), F.col("text").alias("text")))
    calls = asked.select(
        F.col("conv_id").alias("conversation"), turn.alias("position"), ident(turn).alias("call_id"),
        F.when(F.col("role") == "system", "setup").otherwise("answer").alias("tool"), arguments.alias("arguments"), F.array(ident(turn - 1), ident(turn - 2)).alias("needs"),
    )
    answered = table.where(F.col("role") == "assistant")
    return calls, answered.select(ident(turn - 1).alias("call_id"), turn.alias("position"), F.col("text").alias("content"))


def op3_tool_calls(spark, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = link(*conversation_calls(table))
    return rows.withColumnsRenamed({"conversation": "conv_id", "position": "turn"}).withColumn("level", F.col("level").cast("long"))


ORACLE_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn::BIGINT AS turn, 'c' || conv_id || '-' || turn AS call_id,
         CASE WHEN role = 'system' THEN 'setup' ELSE 'answer' END AS tool, text
  FROM conversations WHERE role IS DISTINCT FROM 'assistant'
), paths(conv_id, turn, length) AS (
  SELECT conv_id, turn, 0 FROM calls
  UNION
  SELECT c.conv_id, c.turn, p.length + 1 FROM paths p JOIN calls c ON c.conv_id = p.conv_id AND c.turn - p.turn IN (1, 2)
), levels AS (
  SELECT conv_id, turn, max(length)::BIGINT AS level FROM paths GROUP BY ALL
), results AS (
  SELECT 'c' || conv_id || '-' || (turn - 1) AS call_id, arg_min(text, turn) AS content, count(*) AS n
  FROM conversations WHERE role = 'assistant' GROUP BY 1
), errors AS (
  SELECT conv_id, turn, array_to_string(list_sort(list_filter([
    CASE WHEN text IS NULL THEN 'missing text' WHEN length(text) > 1000 THEN 'text is longer than 1000' END,
    CASE WHEN tool = 'answer' AND turn < 1 THEN 'turn is under 1' WHEN tool = 'setup' AND turn > 0 THEN 'turn is over 0' END
  ], lambda x: x IS NOT NULL)), '; ') AS errors FROM calls
)
SELECT c.conv_id, c.turn, coalesce(c.call_id, r.call_id) AS call_id, c.tool,
       CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.n IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
       l.level, coalesce(r.n, 0)::BIGINT AS n_results, coalesce(e.errors = '', false) AS valid, coalesce(e.errors, 'no call') AS errors,
       '{"arguments":' || CASE WHEN c.call_id IS NULL THEN 'null' WHEN c.text IS NULL THEN '{"turn":' || c.turn || '}'
           ELSE '{"text":' || to_json(c.text)::VARCHAR || ',"turn":' || c.turn || '}' END
         || ',"id":' || to_json(coalesce(c.call_id, r.call_id))::VARCHAR || ',"name":' || coalesce(to_json(c.tool)::VARCHAR, 'null')
         || ',"result":' || coalesce(to_json(r.content)::VARCHAR, 'null') || '}' AS json
FROM calls c LEFT JOIN levels l USING (conv_id, turn) LEFT JOIN errors e USING (conv_id, turn) FULL JOIN results r ON c.call_id = r.call_id
"""
