"""The answer that leaves the system: its closed schema, its check, and its repair where it breaks the shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import vocabulary as v
from lodestone.functions.json_schema import Schema, fields, items, json_safe, kind

_VALUE = {"$ref": "#/$defs/jsonValue"}
_OBJECT = {"type": "object", "additionalProperties": _VALUE}

#: The wire format of an answer.
FINAL_RESPONSE = {
    "type": "object",
    "additionalProperties": False,
    "required": ["question", "retrieved_context", "think_trace", "answer"],
    "properties": {
        "question": {"type": "string"},
        "retrieved_context": {"type": "array", "items": _VALUE},
        "think_trace": {
            "type": "object",
            "additionalProperties": False,
            "required": ["execution_mode", "operations", "calculation", "validation"],
            "properties": {"execution_mode": {"enum": list(v.ROUTES)}, "operations": {"type": "array", "items": _VALUE}, "calculation": _OBJECT, "validation": _OBJECT},
        },
        "answer": {"type": "string"},
    },
    "$defs": {"jsonValue": {"anyOf": [*({"type": t} for t in ("null", "boolean", "number", "string")), {"type": "array", "items": _VALUE}, _OBJECT]}},
}
#: What stands in for an answer that is none.
NO_ANSWER = "정보 한계로 답변할 수 없습니다."
DEFAULT_ROUTE = "EARLY_EXIT"


def checked(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``problems`` (array of "/path keyword", empty for a right answer) of a column of JSON text.

    What is no JSON, NaN and Infinity among it, has the problem "/ value".
    """
    return df.withColumn("_v", F.try_parse_json(text)).withColumn("problems", Schema(FINAL_RESPONSE).problems("_v")).drop("_v")


def problems(df: DataFrame, question: str, text: str) -> DataFrame:
    """(rule, key, message) of responses that break the closed schema at any depth (SCHEMA, each breach) or do not echo the
    question that was asked (ECHO)."""
    rows = checked(df, text)
    schema = rows.select(F.lit("SCHEMA").alias("rule"), F.col(question).cast("string").alias("key"), F.explode("problems").alias("message"))
    echoed = F.try_variant_get(F.try_parse_json(text), "$.question", "string")
    silent = rows.filter(F.try_parse_json(text).isNotNull() & ~echoed.eqNullSafe(F.col(question))).select(F.lit("ECHO").alias("rule"), F.col(question).cast("string").alias("key"), F.lit("the question is not echoed").alias("message"))
    return schema.unionByName(silent)


def _string(x: str, otherwise: str) -> Column:
    return F.coalesce(F.expr(f"IF({kind(x)} = 'STRING', try_variant_get({x}, '$', 'string'), NULL)"), F.lit(otherwise))


def repaired(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``response``, the answer as JSON text in its right shape, whatever came in.

    Numbers that are not finite become null and values that are too deep a mark; fields of another type than their own
    become empty ones, an unknown route DEFAULT_ROUTE, a missing answer NO_ANSWER; unknown fields go.
    """
    trace = "_t"
    part = lambda whole, name: f"{fields(whole)}['{name}']"
    array = lambda x: F.coalesce(F.expr(items(x)), F.expr("CAST(array() AS array<variant>)"))
    mapping = lambda x: F.coalesce(F.expr(fields(x)), F.expr("CAST(map() AS map<string, variant>)"))
    rows = df.withColumn("_v", F.try_parse_json(json_safe(text))).withColumn(trace, F.expr(part("_v", "think_trace")))
    route = _string(part(trace, "execution_mode"), DEFAULT_ROUTE)
    shaped = F.struct(
        _string(part("_v", "question"), "").alias("question"),
        array(part("_v", "retrieved_context")).alias("retrieved_context"),
        F.struct(
            F.when(route.isin(list(v.ROUTES)), route).otherwise(DEFAULT_ROUTE).alias("execution_mode"),
            array(part(trace, "operations")).alias("operations"),
            mapping(part(trace, "calculation")).alias("calculation"),
            mapping(part(trace, "validation")).alias("validation"),
        ).alias("think_trace"),
        _string(part("_v", "answer"), NO_ANSWER).alias("answer"),
    )
    return rows.withColumn("response", F.to_json(F.to_variant_object(shaped))).drop("_v", trace)
