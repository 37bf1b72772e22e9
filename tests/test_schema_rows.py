"""JSON Schema: native and row-by-row evaluation agree, and odd texts and schemas cost one row, not the job."""

import json

import pytest
from conftest import run

from sievekit.functions import schema_rows
from sievekit.functions.jsonschema import SchemaError, compile_schema

CASES = [
    ({"type": "number"}, [("1", True), ("NaN", True), ('"x"', False), ("true", False)]),
    ({"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}, [('{"a":1,"a":2}', True), ('{"a":2,"a":"x"}', False), ("{}", False)]),
    ({"required": ["é"]}, [('{"é":null}', True), ('{"e":1}', False)]),
    ({"required": [""], "properties": {"": {"type": "string"}}}, [('{"":"x"}', True), ('{"":1}', False), ("{}", False)]),
    ({"type": "string", "pattern": "(?P<n>ab)+$"}, [('"xabab"', True), ('"xa"', False)]),
    ({"minimum": 3, "exclusiveMinimum": True}, [("3", False), ("4", True)]),
    ({"$ref": "#/$defs/n", "$defs": {"n": {"type": "integer"}}}, [("1", True), ('"x"', False)]),
    ({"if": {"type": "string"}, "then": {"minLength": 2}, "else": {"type": "integer"}}, [('"ab"', True), ('"a"', False), ("1", True), ("[]", False)]),
    ({"patternProperties": {"^x": {"type": "integer"}}, "additionalProperties": False}, [('{"x1":1}', True), ('{"x1":"a"}', False), ('{"y":1}', False)]),
    ({"propertyNames": {"maxLength": 2}}, [('{"ab":1}', True), ('{"abc":1}', False)]),
    ({"contains": {"const": 3}, "maxContains": 1}, [("[1,3]", True), ("[1]", False), ("[3,3]", False)]),
    ({"dependentRequired": {"a": ["b"]}}, [('{"a":1}', False), ('{"a":1,"b":2}', True), ('{"b":1}', True)]),
    ({"items": [{"type": "integer"}], "additionalItems": False}, [("[1]", True), ("[1,2]", False), ('["a"]', False)]),
    ({"prefixItems": [{"type": "integer"}], "items": {"type": "string"}}, [('[1,"a"]', True), ("[1,2]", False), ("[]", True)]),
    ({"multipleOf": 0.1}, [("0.3", True), ("0.35", False)]),
    ({"enum": [1, "a", None]}, [("1.0", True), ("true", False), ("null", True), ('"b"', False)]),
    ({"uniqueItems": True}, [("[1,true]", True), ("[1,1.0]", False)]),
]


@pytest.mark.parametrize("schema,texts", CASES, ids=[json.dumps(s)[:40] for s, _ in CASES])
def test_conformance(spark, schema, texts):
    got = run(spark, [t for t, _ in texts], {"file_type": [f"json-with-schema:{json.dumps(schema)}"]})
    assert [not g for g in got] == [ok for _, ok in texts]
    assert [schema_rows.conforms(json.loads(t), schema) for t, _ in texts] == [ok for _, ok in texts]


def test_deep_nesting_is_one_invalid_row(spark):
    texts = ["[" * 200_000 + "]" * 200_000, "[1]"]
    got = run(spark, texts, {"file_type": ["json"]})
    assert [len(g) for g in got] == [1, 0]


def test_what_the_native_form_leaves_to_rows():
    for schema in ({"$ref": "#"}, {"if": True}, {"exclusiveMinimum": True}, {"items": [True]}, {"pattern": "(?P<a>x)"}):
        with pytest.raises(SchemaError):
            compile_schema(schema)
    with pytest.raises(ValueError, match="unsupported"):
        schema_rows.check_references({"properties": {"a": {"$ref": "#/nowhere"}}})
