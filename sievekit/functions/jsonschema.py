"""Compile a JSON Schema once on the driver into a boolean Column over a VARIANT value.

Covers the common assertion keywords (``SUPPORTED``). Anything else that asserts,
``$ref`` included, raises ``SchemaError``; such schemas are evaluated row by row by
``schema_rows.conforms``. Annotations, ``format`` among them, are ignored.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievekit.functions.spans import to_java

ANNOTATIONS = {"$schema", "$id", "id", "title", "description", "default", "examples", "$comment", "readOnly", "writeOnly", "deprecated", "definitions", "$defs", "format", "contentMediaType", "contentEncoding"}
SUPPORTED = {
    "type", "enum", "const", "required", "properties", "additionalProperties", "items", "prefixItems",
    "minItems", "maxItems", "uniqueItems", "minProperties", "maxProperties", "minimum", "maximum",
    "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "pattern",
    "allOf", "anyOf", "oneOf", "not",
}
NUMERIC_PREFIXES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")


class SchemaError(ValueError):
    pass


def _vtype(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_object(v):
    return _vtype(v).startswith("OBJECT")


def _is_array(v):
    return _vtype(v).startswith("ARRAY")


def _is_string(v):
    return _vtype(v) == F.lit("STRING")


def _is_bool(v):
    return _vtype(v) == F.lit("BOOLEAN")


def _is_null(v):
    return _vtype(v) == F.lit("VOID")


def _is_number(v):
    t = _vtype(v)
    cond = F.lit(False)
    for p in NUMERIC_PREFIXES:
        cond = cond | t.startswith(p)
    return cond


def _num(v):
    return F.try_variant_get(v, "$", "double")


def _is_integer(v):
    n = _num(v)
    return _is_number(v) & (n == F.floor(n))


def _canon(v: Column) -> Column:
    return F.to_json(v)


def _canon_literal(value) -> Column:
    return F.to_json(F.parse_json(F.lit(json.dumps(value))))


def _type_check(v, name: str) -> Column:
    return {
        "object": _is_object,
        "array": _is_array,
        "string": _is_string,
        "number": _is_number,
        "integer": _is_integer,
        "boolean": _is_bool,
        "null": _is_null,
    }[name](v)


def _field(v: Column, key: str) -> Column:
    if re.fullmatch(r"[A-Za-z0-9_]+", key):
        return F.try_variant_get(v, f"$.{key}", "variant")
    return F.try_element_at(_as_map(v), F.lit(key))  # names that a path can't spell


def _as_map(v):
    return F.try_variant_get(v, "$", "map<string,variant>")


def _as_array(v):
    return F.try_variant_get(v, "$", "array<variant>")


def compile_schema(schema) -> "callable":
    """Return ``f(variant Column) -> boolean Column``. Raises SchemaError for unsupported schemas."""
    if schema is True:
        return lambda v: F.lit(True)
    if schema is False:
        return lambda v: F.lit(False)
    if not isinstance(schema, dict):
        raise SchemaError(f"schema must be an object or boolean, got {type(schema).__name__}")
    unknown = set(schema) - SUPPORTED - ANNOTATIONS
    if not isinstance(schema.get("required", []), list):
        unknown.add("required")
    if unknown:
        raise SchemaError(f"unsupported JSON Schema keywords: {sorted(unknown)}")

    checks = []
    s = schema
    if "type" in s:
        types = s["type"] if isinstance(s["type"], list) else [s["type"]]
        for t in types:
            if t not in ("object", "array", "string", "number", "integer", "boolean", "null"):
                raise SchemaError(f"unknown type {t!r}")

        def type_check(v, types=types):
            cond = F.lit(False)
            for t in types:
                cond = cond | _type_check(v, t)
            return cond

        checks.append(type_check)
    if "enum" in s:
        values = s["enum"]
        checks.append(lambda v, values=values: _canon(v).isin([_canon_literal(x) for x in values]) if values else F.lit(False))
    if "const" in s:
        c = s["const"]
        checks.append(lambda v, c=c: _canon(v) == _canon_literal(c))

    # object keywords apply only to objects
    obj_checks = []
    for key in s.get("required", []):
        obj_checks.append(lambda v, key=key: _field(v, key).isNotNull())
    props = s.get("properties", {})
    for key, sub in props.items():
        subf = compile_schema(sub)
        obj_checks.append(lambda v, key=key, subf=subf: F.when(_field(v, key).isNull(), F.lit(True)).otherwise(subf(_field(v, key))))
    if "additionalProperties" in s:
        ap = s["additionalProperties"]
        known = list(props.keys())
        apf = compile_schema(ap)

        def ap_check(v, known=known, apf=apf):
            entries = F.map_entries(_as_map(v))
            extra = F.filter(entries, lambda e: ~e["key"].isin(known)) if known else entries
            return F.forall(extra, lambda e: apf(e["value"]))

        obj_checks.append(ap_check)
    if "minProperties" in s:
        n = int(s["minProperties"])
        obj_checks.append(lambda v, n=n: F.size(F.map_keys(_as_map(v))) >= n)
    if "maxProperties" in s:
        n = int(s["maxProperties"])
        obj_checks.append(lambda v, n=n: F.size(F.map_keys(_as_map(v))) <= n)
    if obj_checks:
        checks.append(lambda v, oc=obj_checks: ~_is_object(v) | _all(v, oc))

    arr_checks = []
    if "items" in s:
        itf = compile_schema(s["items"])
        start = len(s.get("prefixItems", []))
        arr_checks.append(lambda v, itf=itf, start=start: F.forall(F.filter(_as_array(v), lambda _, i: i >= start) if start else _as_array(v), itf))
    for i, sub in enumerate(s.get("prefixItems", [])):
        subf = compile_schema(sub)
        arr_checks.append(lambda v, i=i, subf=subf: F.when(F.size(_as_array(v)) <= i, F.lit(True)).otherwise(subf(F.get(_as_array(v), i))))
    if "minItems" in s:
        n = int(s["minItems"])
        arr_checks.append(lambda v, n=n: F.size(_as_array(v)) >= n)
    if "maxItems" in s:
        n = int(s["maxItems"])
        arr_checks.append(lambda v, n=n: F.size(_as_array(v)) <= n)
    if s.get("uniqueItems"):
        arr_checks.append(lambda v: F.size(F.array_distinct(F.transform(_as_array(v), _canon))) == F.size(_as_array(v)))
    if arr_checks:
        checks.append(lambda v, ac=arr_checks: ~_is_array(v) | _all(v, ac))

    num_checks = []
    for key in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf"):
        if key in s and (isinstance(s[key], bool) or not isinstance(s[key], (int, float))):
            raise SchemaError(f"unsupported value of {key}: {s[key]!r}")
    if s.get("multipleOf", 1) != int(s.get("multipleOf", 1)):
        raise SchemaError("a fractional multipleOf needs decimal arithmetic")
    if "minimum" in s:
        x = float(s["minimum"])
        num_checks.append(lambda v, x=x: _num(v) >= x)
    if "maximum" in s:
        x = float(s["maximum"])
        num_checks.append(lambda v, x=x: _num(v) <= x)
    if "exclusiveMinimum" in s:
        x = float(s["exclusiveMinimum"])
        num_checks.append(lambda v, x=x: _num(v) > x)
    if "exclusiveMaximum" in s:
        x = float(s["exclusiveMaximum"])
        num_checks.append(lambda v, x=x: _num(v) < x)
    if "multipleOf" in s:
        x = float(s["multipleOf"])
        num_checks.append(lambda v, x=x: (_num(v) / x) == F.floor(_num(v) / x))
    if num_checks:
        checks.append(lambda v, nc=num_checks: ~_is_number(v) | _all(v, nc))

    str_checks = []
    sval = lambda v: F.try_variant_get(v, "$", "string")
    if "minLength" in s:
        n = int(s["minLength"])
        str_checks.append(lambda v, n=n: F.length(sval(v)) >= n)
    if "maxLength" in s:
        n = int(s["maxLength"])
        str_checks.append(lambda v, n=n: F.length(sval(v)) <= n)
    if "pattern" in s:
        pat = s["pattern"]
        re.compile(pat)
        jp = to_java(pat)
        if jp is None:
            raise SchemaError(f"pattern not supported natively: {pat!r}")
        str_checks.append(lambda v, jp=jp: sval(v).rlike(jp))
    if str_checks:
        checks.append(lambda v, sc=str_checks: ~_is_string(v) | _all(v, sc))

    for sub in s.get("allOf", []):
        checks.append(compile_schema(sub))
    if "anyOf" in s:
        subs = [compile_schema(x) for x in s["anyOf"]]
        checks.append(lambda v, subs=subs: _any(v, subs))
    if "oneOf" in s:
        subs = [compile_schema(x) for x in s["oneOf"]]
        checks.append(lambda v, subs=subs: sum((F.when(f(v), 1).otherwise(0) for f in subs), F.lit(0)) == 1)
    if "not" in s:
        nf = compile_schema(s["not"])
        checks.append(lambda v, nf=nf: ~nf(v))

    return lambda v: _all(v, checks)


def _all(v, fs) -> Column:
    cond = F.lit(True)
    for f in fs:
        cond = cond & F.coalesce(f(v), F.lit(False))
    return cond


def _any(v, fs) -> Column:
    cond = F.lit(False)
    for f in fs:
        cond = cond | F.coalesce(f(v), F.lit(False))
    return cond
