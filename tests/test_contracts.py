"""JSON schemas over Variant columns, JSON-safe text and the shape of answers."""

import json

import pytest
from pyspark.sql import functions as F

from lodestone.functions.json_schema import Schema, json_safe, with_field
from lodestone.operators import responses


def problems(spark, schema, values):
    rows = [(i, x if isinstance(x, str) else json.dumps(x)) for i, x in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, s string").withColumn("v", F.try_parse_json("s"))
    s = Schema(schema)
    out = df.select("i", s.problems("v").alias("p"), s.valid("v").alias("ok")).orderBy("i").collect()
    assert all(r["ok"] == (r["p"] == []) for r in out)
    return [sorted(r["p"]) for r in out]


def test_every_keyword(spark):
    schema = {
        "$defs": {"id": {"type": "string", "pattern": "^[a-z]+'\\\\?[0-9]$"}},
        "type": ["object", "null"],
        "additionalProperties": {"type": "integer"},
        "required": ["a"],
        "properties": {
            "a": {"$ref": "#/$defs/id"},
            "b": {"type": "array", "items": {"enum": [1, "x", None, {"k": [1]}]}, "minItems": 1, "maxItems": 3, "uniqueItems": True},
            "c": {"const": True},
            "d": {"type": "string", "format": "date"},
            "e": {"type": "string", "format": "date-time"},
            "f": {"type": "number", "minimum": -1.5, "maximum": 2},
            "g": {"type": "string", "minLength": 2, "maxLength": 3},
            "h": {"anyOf": [{"type": "string"}, {"type": "integer", "minimum": 5}]},
            "i": {"oneOf": [{"type": "integer"}, {"minimum": 3}]},
            "j": {"not": {"type": "boolean"}},
            "k": {"if": {"type": "object", "required": ["t"]}, "then": {"properties": {"t": {"const": 1}}}, "else": {"type": "null"}},
            "l": {"allOf": [{"type": "object"}, {"required": ["z"]}]},
            "m": False,
        },
    }
    good = {"a": "ab'\\7", "b": [1, {"k": [1]}], "c": True, "d": "2024-02-29", "e": "2024-01-01T10:00:00+09:00", "f": 2, "g": "é日", "h": 7, "i": 2, "j": 0, "k": {"t": 1}, "l": {"z": None}, "other": 3}
    bad = {
        "/a pattern": {"a": "ab7"}, "/a type": {"a": 1}, "/b/1 enum": {"b": [1, 2]}, "/b minItems": {"b": []}, "/b uniqueItems": {"b": [1, 1]}, "/b type": {"b": {"0": 1}}, "/c const": {"c": 1},
        "/d format": {"d": "2023-02-29"}, "/e format": {"e": "2024-01-01"}, "/f maximum": {"f": 2.01}, "/f minimum": {"f": -2}, "/g minLength": {"g": "é"}, "/g maxLength": {"g": "abcd"}, "/h anyOf": {"h": 4},
        "/i oneOf": {"i": 3}, "/j not": {"j": False}, "/k/t const": {"k": {"t": 2}}, "/k type": {"k": {"u": 2}}, "/l required z": {"l": {}}, "/m false": {"m": 1}, "/other type": {"other": "x"},
    }
    got = problems(spark, schema, [good, None, *(good | x for x in bad.values()), {k: v for k, v in good.items() if k != "a"}, [], "nope"])
    assert got[:2] == [[], []]
    assert got[2:-3] == [[name] for name in bad]
    assert got[-3:] == [["/ required a"], ["/ type"], ["/ value"]]


def test_what_cannot_be_compiled_is_refused():
    for schema in ({"$ref": "other.json"}, {"patternProperties": {}}, {"$ref": "#/$defs/x", "$defs": {"x": {"properties": {"y": {"$ref": "#/$defs/x"}}}}}):
        with pytest.raises(ValueError):
            Schema(schema)


@pytest.mark.parametrize("path", [(), ("think_trace",)])
def test_closed_at_every_depth(spark, path):
    good = {"question": "q", "retrieved_context": [1, {"a": [None, "x"]}], "think_trace": {"execution_mode": "BOTH", "operations": [], "calculation": {"a": {"b": 1}}, "validation": {}}, "answer": "a"}
    bad = json.loads(json.dumps(good))
    at = bad
    for name in path:
        at = at[name]
    at["__unexpected_field"] = True
    got = problems(spark, responses.FINAL_RESPONSE, [good, bad, json.dumps(good).replace("1", "1e999")])
    assert got == [[], [f"/{'/'.join((*path, '__unexpected_field'))} additionalProperties"], ["/retrieved_context/0 jsonValue", "/think_trace/calculation/a jsonValue"]]
    v = spark.createDataFrame([(json.dumps(good),)], "s string").withColumn("v", F.try_parse_json("s"))
    assert json.loads(v.select(F.to_json(with_field("v", "answer", [1]))).first()[0]) == good | {"answer": [1]}


def nested(n, x):
    return "[" * n + x + "]" * n


def test_json_safe(spark):
    cases = {
        '{"a": NaN, "b": [Infinity, -Infinity, 1e999, 1.5], "c": "NaN [["}': '{"a":null,"b":[null,null,null,1.5],"c":"NaN [["}',
        nested(20, "7"): nested(20, "7"),
        nested(21, "7, 8"): nested(21, '"[Truncated]","[Truncated]"'),
        nested(100_000, '{"a": "]"}'): nested(21, '"[Truncated]"'),
        '"é\\n"': '"é\\n"',
        "nope": None,
        "": None,
    }
    df = spark.createDataFrame([*((s,) for s in cases), (None,)], "s string")
    assert {r[0]: r[1] for r in df.select("s", json_safe("s")).collect()} == cases | {None: None}


def test_answers_are_repaired(spark):
    empty = {"question": "", "retrieved_context": [], "think_trace": {"execution_mode": "EARLY_EXIT", "operations": [], "calculation": {}, "validation": {}}, "answer": responses.NO_ANSWER}
    cases = ["nope", None, "[]", "{}", '{"question": 1, "answer": null, "think_trace": [], "x": 1}', '{"answer": "a", "think_trace": {"execution_mode": "BOTH", "calculation": {"x": NaN}}}']
    out = [json.loads(r["response"]) for r in responses.repaired(spark.createDataFrame(list(enumerate(cases)), "i int, m string").orderBy("i"), "m").collect()]
    assert out[:5] == [empty] * 5
    assert out[5] == empty | {"answer": "a", "think_trace": empty["think_trace"] | {"execution_mode": "BOTH", "calculation": {"x": None}}}
