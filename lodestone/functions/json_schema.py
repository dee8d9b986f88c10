"""JSON Schema over Variant columns: a schema becomes one SQL expression, and nothing leaves the JVM.

``problems`` gives every breach as "/path keyword", ``valid`` whether there is none. Objects can be closed at every depth
(additionalProperties), arrays are checked item by item. ``json_safe`` gives what JSON can carry of a text.

Expressions are put together as text, since a column made call by call takes seconds for a schema of some size.
"""

from __future__ import annotations

import itertools
import json
import math
import re
from collections.abc import Callable, Mapping
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Values below this depth are not looked into.
DEPTH = 20
TRUNCATED = "[Truncated]"
_ALL_TYPES = {"null", "boolean", "number", "string", "array", "object"}
_FORMATS = {
    "date": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$",
    "date-time": r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])[Tt ]([01]\d|2[0-3]):[0-5]\d:([0-5]\d|60)(\.\d+)?([Zz]|[+-]([01]\d|2[0-3]):?[0-5]\d)$",
}
#: Keywords that say nothing about a value.
_NOTES = {"$schema", "$id", "$defs", "$comment", "title", "description", "default", "examples"}
_NONE = "CAST(array() AS array<string>)"
#: Names of lambda variables, so that inner ones never hide outer ones.
_names = (f"x{i}" for i in itertools.count())


def literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(x: str, use: Callable[[str], str]) -> str:
    """``use`` of x, where x is computed once and stands in the expression once."""
    name = next(_names)
    return f"transform(array({x}), {name} -> {use(name)})[0]"


def kind(v: str) -> str:
    """OBJECT, ARRAY, STRING, BOOLEAN, BIGINT, DECIMAL, DOUBLE or VOID (a JSON null); null for no value at all."""
    return f"regexp_extract(schema_of_variant({v}), '^[A-Z]+', 0)"


def fields(v: str) -> str:
    """The fields of an object by name; null for anything else."""
    return f"try_variant_get({v}, '$', 'map<string,variant>')"


def items(v: str) -> str:
    """The items of an array; null for anything else."""
    return f"try_variant_get({v}, '$', 'array<variant>')"


def has_type(v: str, name: str) -> str:
    if name == "object":
        return f"{fields(v)} IS NOT NULL"
    if name == "array":
        return f"{items(v)} IS NOT NULL"
    number = f"try_variant_get({v}, '$', 'double')"
    if name == "number":
        ok = f"{kind(v)} IN ('BIGINT', 'DECIMAL', 'DOUBLE', 'FLOAT') AND NOT isnan({number}) AND abs({number}) < double('Infinity')"
    elif name == "integer":
        ok = f"({kind(v)} = 'BIGINT' OR {kind(v)} IN ('DECIMAL', 'DOUBLE', 'FLOAT') AND {number} = floor({number}))"
    else:
        ok = f"{kind(v)} = '{ {'string': 'STRING', 'boolean': 'BOOLEAN', 'null': 'VOID'}[name] }'"
    return f"coalesce({v} IS NOT NULL AND {ok}, false)"


def same(v: str, value: Any) -> str:
    """Whether the JSON value is this one, the order of keys aside."""
    return f"coalesce(to_json({v}) = to_json(parse_json({literal(json.dumps(value, ensure_ascii=False))})), false)"


def json_value(v: str, depth: int = DEPTH) -> str:
    """Whether JSON can carry the value: no number in it is infinite or not a number, and it is at most ``depth`` deep."""
    if depth < 0:
        return f"({fields(v)} IS NULL AND {items(v)} IS NULL)"
    name = next(_names)
    inside = f"coalesce(forall(coalesce({items(v)}, map_values({fields(v)})), {name} -> {json_value(name, depth - 1)}), true)"
    return f"CASE WHEN {kind(v)} IN ('DOUBLE', 'FLOAT') THEN {has_type(v, 'number')} ELSE {v} IS NOT NULL AND {inside} END"


def _breach(ok: str, path: str, keyword: str) -> str:
    return f"IF(coalesce({ok}, false), {_NONE}, array(concat({path}, {literal(' ' + keyword)})))"


def _at(path: str, name: str) -> str:
    """The path of a field or item; ``name`` is SQL."""
    return f"concat({path}, '/', CAST({name} AS string))"


class Schema:
    """A JSON Schema, compiled.

    Keywords: type, enum, const, pattern, minLength, maxLength, format (date, date-time), minimum, maximum, minItems,
    maxItems, uniqueItems, items, properties, required, additionalProperties, allOf, anyOf, oneOf, not, if/then/else, $ref
    within the document. A definition that refers to itself must be that of any JSON value; other keywords, and other
    recursion, raise ValueError, so that nothing is left unchecked in silence.
    """

    def __init__(self, schema: Mapping[str, Any]) -> None:
        self.root = schema
        name = next(_names)
        fixed = f"transform({bound('{v}', lambda x: self._of(schema, x, literal(''), ()))}, {name} -> IF(startswith({name}, '/'), {name}, concat('/', {name})))"
        self._sql = f"IF({{v}} IS NULL, array('/ value'), {fixed})"

    def problems(self, column: str) -> Column:
        """Of a Variant column (by name): an array of "/path keyword", in the order of the schema; ["/ value"] for null."""
        return F.expr(self._sql.replace("{v}", f"`{column}`"))

    def valid(self, column: str) -> Column:
        """False for null and for values that break a rule; never null."""
        return F.size(self.problems(column)) == 0

    def _resolve(self, ref: str) -> Mapping[str, Any]:
        if not ref.startswith("#/"):
            raise ValueError(f"only references within the schema: {ref}")
        out: Any = self.root
        for name in ref[2:].split("/"):
            out = out[name]
        return out

    def _any_value(self, schema: Mapping[str, Any], ref: str) -> bool:
        """Whether this is the definition of any JSON value, by reference to itself."""
        types = {s.get("type"): s for s in schema.get("anyOf", ())}
        return set(types) == _ALL_TYPES and types["array"].get("items") == {"$ref": ref} and types["object"].get("additionalProperties") == {"$ref": ref}

    def _holds(self, schema: Any, v: str, refs: tuple[str, ...]) -> str:
        return f"(size({self._of(schema, v, literal(''), refs)}) = 0)"

    def _each(self, values: str, rule: Any, path: str, refs: tuple[str, ...]) -> str:
        x, i = next(_names), next(_names)
        return f"coalesce(flatten(transform({values}, ({x}, {i}) -> {self._of(rule, x, _at(path, i), refs)})), {_NONE})"

    def _property(self, v: str, name: str, rule: Any, path: str, refs: tuple[str, ...]) -> str:
        inner = bound(f"{fields(v)}[{literal(name)}]", lambda x: self._of(rule, x, _at(path, literal(name)), refs))
        return f"IF(coalesce(map_contains_key({fields(v)}, {literal(name)}), false), {inner}, {_NONE})"

    def _others(self, v: str, known: list[str], rule: Any, path: str, refs: tuple[str, ...]) -> str:
        """Of the fields that have no rule by name."""
        e, k = next(_names), next(_names)
        other = f"map_filter({fields(v)}, ({k}, {e}) -> {k} NOT IN ({', '.join(map(literal, known))}))" if known else fields(v)
        if rule is False:
            return f"coalesce(transform(map_keys({other}), {k} -> concat({_at(path, k)}, ' additionalProperties')), {_NONE})"
        inner = self._of(rule, f"{e}.value", _at(path, f"{e}.key"), refs)
        return f"coalesce(flatten(transform(map_entries({other}), {e} -> {inner})), {_NONE})"

    def _of(self, schema: Any, v: str, path: str, refs: tuple[str, ...]) -> str:
        if isinstance(schema, bool):
            return _breach(str(schema).lower(), path, "false")
        out: list[str] = []
        text = f"IF({kind(v)} = 'STRING', try_variant_get({v}, '$', 'string'), NULL)"
        number = f"IF({has_type(v, 'number')}, try_variant_get({v}, '$', 'decimal(38,9)'), NULL)"
        for keyword, rule in schema.items():
            if keyword in _NOTES or keyword in ("then", "else"):
                continue
            if keyword == "$ref":
                target = self._resolve(rule)
                if self._any_value(target, rule):
                    out.append(_breach(json_value(v), path, "jsonValue"))
                elif rule in refs:
                    raise ValueError(f"{rule} refers to itself")
                else:
                    out.append(self._of(target, v, path, (*refs, rule)))
            elif keyword == "type":
                out.append(_breach(" OR ".join(has_type(v, name) for name in ([rule] if isinstance(rule, str) else rule)), path, keyword))
            elif keyword in ("enum", "const"):
                out.append(_breach(" OR ".join(same(v, value) for value in (rule if keyword == "enum" else [rule])), path, keyword))
            elif keyword in ("pattern", "format"):
                pattern = _FORMATS.get(rule) if keyword == "format" else rule
                if pattern:
                    real = f" AND try_to_date(substring({text}, 1, 10), 'yyyy-MM-dd') IS NOT NULL" if keyword == "format" else ""
                    out.append(_breach(f"{text} IS NULL OR ({text} RLIKE {literal(pattern)}{real})", path, keyword))
            elif keyword in ("minLength", "maxLength"):
                out.append(_breach(f"{text} IS NULL OR char_length({text}) {'>=' if keyword == 'minLength' else '<='} {int(rule)}", path, keyword))
            elif keyword in ("minimum", "maximum"):
                out.append(_breach(f"{number} IS NULL OR {number} {'>=' if keyword == 'minimum' else '<='} {rule!r}", path, keyword))
            elif keyword in ("minItems", "maxItems"):
                out.append(_breach(f"{items(v)} IS NULL OR size({items(v)}) {'>=' if keyword == 'minItems' else '<='} {int(rule)}", path, keyword))
            elif keyword == "uniqueItems":
                if rule:
                    x = next(_names)
                    out.append(_breach(f"{items(v)} IS NULL OR " + bound(f"transform({items(v)}, {x} -> to_json({x}))", lambda t: f"size(array_distinct({t})) = size({t})"), path, keyword))
            elif keyword == "required":
                out += [_breach(f"{fields(v)} IS NULL OR map_contains_key({fields(v)}, {literal(name)})", path, f"required {name}") for name in rule]
            elif keyword == "items":
                out.append(self._each(items(v), rule, path, refs))
            elif keyword == "properties":
                out += [self._property(v, name, inner, path, refs) for name, inner in rule.items()]
            elif keyword == "additionalProperties":
                out.append(self._others(v, list(schema.get("properties", {})), rule, path, refs))
            elif keyword == "allOf":
                out += [self._of(s, v, path, refs) for s in rule]
            elif keyword in ("anyOf", "oneOf"):
                n = " + ".join(f"CAST({self._holds(s, v, refs)} AS int)" for s in rule)
                out.append(_breach(f"{n} {'>=' if keyword == 'anyOf' else '='} 1", path, keyword))
            elif keyword == "not":
                out.append(_breach(f"NOT {self._holds(rule, v, refs)}", path, keyword))
            elif keyword == "if":
                then, other = (self._of(schema[k], v, path, refs) if k in schema else _NONE for k in ("then", "else"))
                out.append(f"IF({self._holds(rule, v, refs)}, {then}, {other})")
            else:
                raise ValueError(f"unknown keyword: {keyword}")
        return f"concat({', '.join(out)})" if out else _NONE


def with_field(column: str, name: str, value: Any = True) -> Column:
    """The object with one field more (or another value of it); null for what is no object."""
    v, new = f"`{column}`", f"parse_json({literal(json.dumps(value, ensure_ascii=False))})"
    return F.expr(f"to_variant_object(map_concat(map_filter({fields(v)}, (k, x) -> k <> {literal(name)}), map({literal(name)}, {new})))")


_PARTS = re.compile(r'"(?:[^"\\]|\\.)*"|[\[{]|[\]}]')


def _shallow(text: str) -> str:
    """The text with ``null`` in place of the containers that are too deep to be looked into."""
    out, depth, at = [], 0, 0
    for m in _PARTS.finditer(text):
        if m[0] in "[{":
            depth += 1
            if depth == DEPTH + 2:
                out.append(text[at : m.start()])
        elif m[0] in "]}":
            depth -= 1
            if depth == DEPTH + 1:
                out.append("null")
                at = m.end()
    return "".join([*out, text[at:]]) if out else text


def _capped(x: Any, depth: int) -> Any:
    if depth > DEPTH:
        return TRUNCATED
    if isinstance(x, dict):
        return {k: _capped(y, depth + 1) for k, y in x.items()}
    return [_capped(y, depth + 1) for y in x] if isinstance(x, list) else x


def _safe(text: str | None) -> str | None:
    if text is None:
        return None
    finite = lambda s: x if math.isfinite(x := float(s)) else None
    try:
        return json.dumps(_capped(json.loads(_shallow(text), parse_float=finite, parse_constant=lambda _: None), 0), ensure_ascii=False, separators=(",", ":"))
    except ValueError:
        return None


@F.pandas_udf(StringType())
def json_safe(text: pd.Series) -> pd.Series:
    """JSON text as JSON can carry it: NaN, Infinity and numbers beyond a double become null, and every value deeper than
    DEPTH (the whole is at 0) becomes TRUNCATED. What is not JSON gives null. (Text in and out: an expression of the
    JVM would need a nested function for each level.)"""
    return text.map(_safe)
