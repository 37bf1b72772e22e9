"""File-type detectors: validity by format, and schema edge cases."""

import json
import random

import pytest
import yaml
from conftest import run

from sievekit.operators import filetype as FT

SCHEMA = json.dumps({"type": "object", "properties": {"port": {"type": "integer", "minimum": 1}, "host": {"type": "string"}}, "required": ["host"]})
XSD = """<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
  <xs:element name="note"><xs:complexType>
    <xs:sequence><xs:element name="day" type="xs:date"/><xs:element name="line" type="xs:string" maxOccurs="3"/></xs:sequence>
    <xs:attribute name="lang" type="xs:language" use="required"/>
  </xs:complexType></xs:element>
</xs:schema>"""


def names(dets):
    return [d["detection"] for d in dets]


@pytest.mark.parametrize(
    "text,bad",
    [
        ('{"host": "h", "port": 80}', {"invalid_xml"}),
        ('{"host": "h", "port": 0}', {"json_schema_mismatch", "invalid_xml"}),
        ("host: h", {"invalid_json", "invalid_xml"}),
        ("host: [h", {"invalid_json", "invalid_xml", "invalid_yaml"}),
        ("<a><b/></a>", {"invalid_json"}),
        ("<a><b></a>", {"invalid_json", "invalid_xml"}),
    ],
)
def test_every_format_in_one_request(spark, text, bad):
    got = run(spark, [text], {"file_type": ["json", f"json-with-schema:{SCHEMA}", "xml", "yaml"]})[0]
    assert set(names(got)) == bad


def test_json_python_rules(spark):
    texts = ["1", "NaN", '{"a": 1, "a": 2}', '{"a":1} x', "", "[1, 2]", '"s"']
    res = run(spark, texts, {"file_type": "json"})
    assert [bool(r) for r in res] == [False, False, False, True, True, False, False]
    assert res[3][0]["start"] == 0 and res[3][0]["end"] == len(texts[3]) and res[3][0]["detection_type"] == "file_type"


def test_invalid_schema_span(spark):
    res = run(spark, ['{"a": 1}', "{bad"], {"file_type": ["json-with-schema:{not json"]})
    assert res[0][0]["detection"] == "invalid_schema" and res[0][0]["end"] == len("{not json") and res[0][0]["text"] == '{"a": 1}'
    assert res[1][0]["detection"] == "invalid_json"


def test_yaml_with_json_schema(spark):
    res = run(spark, ["host: h\nport: 8", "port: 8", "host: [", "host: h\nport: 0"], {"file_type": [f"yaml-with-schema:{SCHEMA}"]})
    assert [names(r) for r in res] == [[], ["yaml_schema_mismatch"], ["invalid_yaml"], ["yaml_schema_mismatch"]]


def test_xml_with_xsd(spark):
    day = "<day>2024-02-29</day>"
    texts = [f'<note lang="en">{day}<line>x</line></note>', f"<note>{day}<line>x</line></note>", '<note lang="en"><day>soon</day><line/></note>', f'<note lang="en">{day}']
    res = run(spark, texts, {"file_type": [f"xml-with-schema:{XSD}"]})
    assert [names(r) for r in res] == [[], ["xml_schema_mismatch"], ["xml_schema_mismatch"], ["invalid_xml"]]


def test_unknown_or_mixed_case_type_raises(spark):
    for bad in ["csv", "JSON"]:
        with pytest.raises(ValueError, match="Unrecognized file type"):
            run(spark, ["{}"], {"file_type": [bad]})


def test_schema_compiler_keywords(spark):
    schema = {
        "type": "object",
        "properties": {
            "n": {"type": "number", "exclusiveMinimum": 0, "multipleOf": 0.5},
            "s": {"type": "string", "minLength": 2, "maxLength": 4, "pattern": "^[a-z]+$"},
            "xs": {"type": "array", "items": {"type": "integer"}, "minItems": 1, "uniqueItems": True},
            "e": {"enum": ["x", 1]},
            "o": {"anyOf": [{"type": "null"}, {"type": "boolean"}]},
        },
        "additionalProperties": False,
    }
    cases = [
        ('{"n": 1.5, "s": "ab", "xs": [1, 2], "e": 1, "o": null}', True),
        ('{"n": 0}', False),
        ('{"n": 1.2}', False),
        ('{"s": "a"}', False),
        ('{"s": "AB"}', False),
        ('{"xs": []}', False),
        ('{"xs": [1, 1]}', False),
        ('{"xs": [1.0]}', True),
        ('{"e": "y"}', False),
        ('{"o": 3}', False),
        ('{"z": 1}', False),
        ("[]", False),
    ]
    res = run(spark, [c for c, _ in cases], {"file_type": [f"json-with-schema:{json.dumps(schema)}"]})
    assert [r == [] for r in res] == [ok for _, ok in cases]


def test_unsupported_keyword_raises(spark):
    with pytest.raises(ValueError, match="unsupported"):
        run(spark, ["{}"], {"file_type": ['json-with-schema:{"$ref": "#/x"}']})


ALIKE = ["a: 1\nb: [x, y]", '{"k": 5}', "{k: 5}", "plain words, and more", "- a\n- b: 2001-01-01", "key: 'x", "# note", "", "a: b: c", "ends in hurray!"]
OWN = ["a:\tb", "{a ?b}", "[a:]", "%Z\n---\na", "! a", "x: |\n y", "[" * 400, "- " * 400 + "a", "\ufeffa: 1", "a\x07", "a\r\nb", "a: b\u2028c", "?" * 3 + "[x?]"]


def test_libyaml_reads_only_what_both_parsers_read_alike():
    def plain(text):
        try:
            return json.dumps(yaml.safe_load(text), default=str)
        except Exception:  # noqa: BLE001
            return None

    assert not any(FT._own_parser_only(t) for t in ALIKE) and all(FT._own_parser_only(t) for t in OWN)
    rng = random.Random(7)
    marks = ["a", "b9", " ", "\n", "\n  ", "\n- ", "- ", ": ", ", ", "? ", " #", "'", '"', "[", "]", "{", "}", "%", "!", "&a ", "*a", "\\n", "@", "\t", "é", "---", ":"]
    for text in ALIKE + OWN + ["".join(rng.choices(marks, k=rng.randint(1, 25))) for _ in range(4_000)]:
        assert FT._yaml_to_json(text) == plain(text), text
