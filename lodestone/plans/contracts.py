"""Queries over JSON: closed schemas, JSON-safe values, answers on the wire. Events and conversations stand in for the
messages, each in a good form or one that is broken in a known way, so that most rules meet thousands of rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions.json_schema import Schema, json_safe, with_field
from lodestone.operators import responses
from lodestone.plans.queries import query

_EVENT = Schema(
    {
        "type": "object",
        "additionalProperties": False,
        "required": ["event_id", "event_type", "value", "props"],
        "properties": {
            "event_id": {"type": "integer", "minimum": 0},
            "event_type": {"enum": ["signup", "error", "click", "view"]},
            "value": {"type": "number", "maximum": 100},
            "props": {"type": "object", "additionalProperties": False, "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 89}}},
            "note": {"type": "string", "pattern": "^n[0-9]+$", "maxLength": 4},
        },
    }
)
#: An event as JSON: as it is, or broken in one of seven ways; the same text in both dialects.
_EVENT_JSON = """
    CASE event_id % 8
        WHEN 1 THEN concat('{"extra":1,"event_id":', event_id, ',"event_type":"', event_type, '","value":', value, ',"props":', props, '}')
        WHEN 2 THEN concat('{"event_id":', event_id, ',"event_type":"', event_type, '","value":', value, ',"props":{"x":[1],', substr(props, 2), '}')
        WHEN 3 THEN concat('{"event_id":"', event_id, '","event_type":"', upper(event_type), '","value":', value, ',"props":', props, '}')
        WHEN 4 THEN concat('{"event_id":', event_id, ',"event_type":"', event_type, '","value":"', value, '","props":[', props, ']}')
        WHEN 5 THEN concat('{"event_id":', event_id, ',"event_type":"', event_type, '","value":', value, '}')
        WHEN 6 THEN concat('{"event_id":', event_id, ',"event_type":"', event_type, '","value":', value, ',"props":', props, ',"note":"n', event_id, '"}')
        WHEN 7 THEN concat('{"event_id":', event_id, ',"event_type":', event_type, ',"value":NaN}')
        ELSE concat('{"event_id":', event_id, ',"event_type":"', event_type, '","value":', value, ',"props":', props, '}')
    END
"""


@query(f"""
    WITH j AS (SELECT event_id, event_id % 8 AS form, {_EVENT_JSON} AS s FROM events),
    g AS (SELECT event_id, CASE WHEN json_valid(s) THEN s END AS s FROM j),
    r AS (
        SELECT event_id, CASE WHEN s IS NULL THEN ['/ value'] ELSE list_sort(list_filter([
            CASE WHEN NOT list_contains(json_keys(s), 'props') THEN '/ required props' END,
            CASE WHEN list_contains(json_keys(s), 'extra') THEN '/extra additionalProperties' END,
            CASE WHEN json_type(s, '$.event_id') = 'VARCHAR' THEN '/event_id type' END,
            CASE WHEN json_extract_string(s, '$.event_type') NOT IN ('signup', 'error', 'click', 'view') THEN '/event_type enum' END,
            CASE WHEN json_type(s, '$.value') = 'VARCHAR' THEN '/value type' END,
            CASE WHEN json_type(s, '$.value') <> 'VARCHAR' AND CAST(json_extract_string(s, '$.value') AS DOUBLE) > 100 THEN '/value maximum' END,
            CASE WHEN json_type(s, '$.props') = 'ARRAY' THEN '/props type' END,
            CASE WHEN json_type(s, '$.props') = 'OBJECT' AND len(json_keys(s, '$.props')) > 1 THEN '/props/x additionalProperties' END,
            CASE WHEN CAST(json_extract_string(s, '$.props.k') AS INTEGER) > 89 THEN '/props/k maximum' END,
            CASE WHEN length(json_extract_string(s, '$.note')) > 4 THEN '/note maxLength' END
        ], lambda x: x IS NOT NULL)) END AS p FROM g
    )
    SELECT event_id, len(p) = 0 AS valid, array_to_string(p, ',') AS problems FROM r
""")
def closed_schema(read):
    events = read("events").select("event_id", F.try_parse_json(F.expr(_EVENT_JSON)).alias("v"))
    found = events.select("event_id", _EVENT.problems("v").alias("p"))
    return found.select("event_id", (F.size("p") == 0).alias("valid"), F.array_join(F.array_sort("p"), ",").alias("problems"))


@query("""
    SELECT event_type, count(*) AS n_valid, count(*) AS n_refused FROM events
    WHERE event_type <> 'purchase' AND value <= 100 AND CAST(json_extract_string(props, '$.k') AS INTEGER) <= 89 GROUP BY event_type
""")
def negative_controls(read):
    """Of messages that the schema takes, how many it refuses with an unknown field: all."""
    message = F.to_json(F.struct("event_id", "event_type", "value")).alias("m")
    events = read("events").select("event_type", F.try_parse_json(F.concat(F.regexp_replace(message, r"\}$", ',"props":'), "props", F.lit("}"))).alias("v"))
    good = events.filter(_EVENT.valid("v")).withColumn("w", with_field("v", "__unexpected_field"))
    return good.groupBy("event_type").agg(F.count("*").alias("n_valid"), F.count_if(~_EVENT.valid("w")).alias("n_refused"))


@query("""
    SELECT event_id, concat('{"v":', CASE WHEN event_type = 'error' THEN 'null' ELSE CAST(event_id AS VARCHAR) END, ',"p":',
        CASE WHEN user_id % 25 >= 20 THEN concat(repeat('[', 20), '"[Truncated]"', repeat(']', 20))
             WHEN user_id % 25 = 19 THEN concat(repeat('[', 19), '{"k":"[Truncated]"}', repeat(']', 19))
             ELSE concat(repeat('[', CAST(user_id % 25 AS INTEGER)), replace(props, ' ', ''), repeat(']', CAST(user_id % 25 AS INTEGER))) END, '}') AS safe FROM events
""")
def json_safe_values(read):
    """Numbers that JSON has not got, and values nested up to 25 deep."""
    n = (F.col("user_id") % 25).cast("int")
    value = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "NaN").otherwise("-1e999")).otherwise(F.col("event_id").cast("string"))
    text = F.concat(F.lit('{"v":'), value, F.lit(',"p":'), F.repeat(F.lit("["), n), "props", F.repeat(F.lit("]"), n), F.lit("}"))
    return read("events").select("event_id", json_safe(text).alias("safe"))


#: An answer on the wire: right, or broken in one of six ways. {0} is the text as JSON.
_ANSWER_JSON = """
    CASE conv_id % 7
        WHEN 1 THEN concat('{{"question":"', role, '","retrieved_context":[],"think_trace":{{"execution_mode":"GUESS","operations":[],"calculation":{{}},"validation":{{}}}},"answer":', {0}, '}}')
        WHEN 2 THEN concat('{{"question":"', role, '","retrieved_context":[{{"turn":', turn, '}}],"think_trace":{{"execution_mode":"BOTH","operations":[],"calculation":{{}},"validation":{{}},"secret":1}},"answer":', {0}, '}}')
        WHEN 3 THEN concat('{{"question":"', role, '","retrieved_context":[{{"turn":', turn, '}},null],"think_trace":{{"execution_mode":"RETRIEVAL","operations":["a"],"calculation":{{"x":', turn, '}},"validation":[]}}}}')
        WHEN 4 THEN concat('{{"question":', turn, ',"retrieved_context":{{"a":', {0}, '}},"think_trace":"none","answer":', {0}, '}}')
        WHEN 5 THEN concat('{{"question":"', role, '","retrieved_context":[NaN,', turn, '],"think_trace":{{"execution_mode":"BOTH","operations":[],"calculation":{{"x":NaN}},"validation":{{}}}},"answer":', {0}, '}}')
        WHEN 6 THEN concat('[', {0}, ']')
        ELSE concat('{{"question":"', role, '","retrieved_context":[{{"turn":', turn, ',"text":', {0}, '}}],"think_trace":{{"execution_mode":"STRUCTURED","operations":[],"calculation":{{"x":1.5}},"validation":{{"ok":true}}}},"answer":', {0}, '}}')
    END
"""


@query(f"""
    WITH j AS (SELECT conv_id, turn, role, text, conv_id % 7 AS form FROM conversations)
    SELECT conv_id, turn, form = 0 AS valid,
        CASE form WHEN 1 THEN '/think_trace/execution_mode enum' WHEN 2 THEN '/think_trace/secret additionalProperties'
                  WHEN 3 THEN '/ required answer,/think_trace/validation type' WHEN 4 THEN '/question type,/retrieved_context type,/think_trace type'
                  WHEN 5 THEN '/ value' WHEN 6 THEN '/ type' ELSE '' END AS problems,
        CASE WHEN form IN (4, 6) THEN '' ELSE role END AS question,
        CASE WHEN form IN (1, 4, 6) THEN 0 WHEN form IN (3, 5) THEN 2 ELSE 1 END AS n_context,
        CASE form WHEN 2 THEN 'BOTH' WHEN 3 THEN 'RETRIEVAL' WHEN 5 THEN 'BOTH' WHEN 0 THEN 'STRUCTURED' ELSE 'EARLY_EXIT' END AS execution_mode,
        CASE form WHEN 3 THEN concat('{{"x":', turn, '}}') WHEN 5 THEN '{{"x":null}}' WHEN 0 THEN '{{"x":1.5}}' ELSE '{{}}' END AS calculation,
        CASE WHEN form IN (3, 6) THEN '{responses.NO_ANSWER}' ELSE text END AS answer,
        true AS right_at_last
    FROM j
""")
def final_responses(read):
    """Answers against their closed schema, and their repair, which is right whatever came in."""
    quoted = "substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)"
    rows = read("conversations").select("conv_id", "turn", F.expr(_ANSWER_JSON.format(quoted)).alias("m"))
    rows = responses.repaired(responses.checked(rows, "m"), "m").withColumn("v", F.parse_json("response"))
    of = lambda path: F.variant_get("v", path, "string")
    context = F.size(F.variant_get("v", "$.retrieved_context", "array<variant>"))
    return rows.select(
        "conv_id", "turn", (F.size("problems") == 0).alias("valid"), F.array_join(F.array_sort("problems"), ",").alias("problems"), of("$.question").alias("question"), context.alias("n_context"),
        of("$.think_trace.execution_mode").alias("execution_mode"), of("$.think_trace.calculation").alias("calculation"), of("$.answer").alias("answer"),
        Schema(responses.FINAL_RESPONSE).valid("v").alias("right_at_last"),
    )
