"""Per-row dispatch: each row's own detectors, arguments and errors, in one pass."""

import json

import pytest

from sievekit.operators import user_examples
from sievekit.operators.custom import CustomRegistry
from sievekit.plans.detect import detect
from sievekit.plans.dispatch import detect_per_row, per_row_calls

SCHEMA = "doc_id long, text string, detector_params string, headers map<string,string>"


def registry():
    return CustomRegistry().from_module(user_examples)


def dispatched(spark, rows, **kw):
    full = [(i, t, json.dumps(p) if not isinstance(p, (str, type(None))) else p, h) for i, (t, p, h) in enumerate(rows)]
    df = spark.createDataFrame(full, SCHEMA)
    return detect_per_row(df, ["doc_id"], headers_col="headers", **kw), df


ROWS = [
    ("xa", {"custom": ["throws_error"]}, None),
    ("xe", {"regex": ["x"], "custom": ["throws_error"]}, None),
    ("x", {"custom": {"function_that_needs_kwargs": {"magic-key": "456"}}}, None),
    ("x", {"custom": {"function_that_needs_kwargs": {"magic-key": "123"}}}, None),
    ("x", {"custom": {"function_that_needs_kwargs": 1}}, None),
    ("x", {"custom": ["function_that_needs_headers"]}, {"magic-key": "7"}),
    ("x", {"custom": ["function_that_needs_headers"]}, {"magic-key": "123"}),
    ("x", {"custom": ["function_that_needs_headers"]}, {}),
    ("x", {"regex": [["a"]]}, None),
    ("a@b.com 1::2", {"regex": ["email", "b.c", "@"], "file_type": ["json"]}, None),
    ('{"a": 1}', {"file_type": ['json-with-schema:{"$ref": "#/d", "d": {"type": "array"}}', "yaml-with-schema:{}", "json-with-schema:{x"]}, None),
    ("1", {"file_type": ['json-with-schema:{"type": 5}']}, None),
    ("1", {"file_type": ["xml-with-schema:<x/>"]}, None),
    ("x", "not json", None),
    ("x", None, None),
    (None, {"regex": ["email", "x"], "custom": ["throws_error"]}, None),
]


def test_errors_arguments_and_headers_reach_their_rows(spark):
    (flat, errors), _ = dispatched(spark, ROWS, registry=registry())
    got = {}
    for r in flat.orderBy("doc_id", "kind_ord", "name_ord", "ord").collect():
        got.setdefault(r.doc_id, []).append((r.detection, r.start, r.end))
    assert got == {
        0: [("throws_error", 0, 2)],
        2: [("function_that_needs_kwargs", 0, 1)],
        5: [("function_that_needs_headers", 0, 1)],
        9: [("email_address", 0, 7), ("custom-regex", 2, 5), ("custom-regex", 1, 2), ("invalid_json", 0, 12)],
        10: [("json_schema_mismatch", 0, 8), ("invalid_schema", 0, 2)],
    }
    failed = {r.doc_id: (r.code, r["name"]) for r in errors.collect()}
    assert {i: c for i, (c, _) in failed.items()} == {1: 500, 4: 500, 7: 500, 8: 500, 11: 500, 12: 400, 13: 422}
    assert failed[1][1] == "throws_error"


def test_counters_see_failing_calls(spark):
    (_, _), df = dispatched(spark, ROWS)
    calls = per_row_calls(df, ["doc_id"], registry=registry(), headers_col="headers").collect()
    by = {(r.doc_id, r.metric_name): (r.hit, r.code) for r in calls}
    assert by[0, "throws_error"] == (True, None) and by[1, "throws_error"] == (False, 500)
    assert by[1, "custom_regex"] == (True, None) and (8, "custom_regex") in by and (12, "xml-with-schema") not in by


def test_many_distinct_schemas(spark):
    rows = [(str(i), {"file_type": [f'json-with-schema:{{"maximum": {i % 2 * 1000}, "title": "{i}"}}']}, None) for i in range(1, 301)]
    (flat, errors), _ = dispatched(spark, rows)
    assert errors.count() == 0 and sorted(r.text for r in flat.collect()) == sorted(str(i) for i in range(2, 301, 2))


def test_failfast_raises(spark):
    (flat, _), _ = dispatched(spark, ROWS[:2], registry=registry(), on_error="failfast")
    with pytest.raises(Exception, match="Detection error"):
        flat.collect()


def test_native_kwargs_come_from_rows(spark):
    rows = [("x", {"custom": {"function_that_needs_kwargs": {"magic-key": v}}}, None) for v in ("123", "9")]
    (flat, errors), _ = dispatched(spark, rows)
    assert [r.doc_id for r in flat.collect()] == [1] and errors.count() == 0


def test_a_function_sees_only_its_rows(spark):
    def noisy(text: str) -> bool:
        if "other" in text:
            raise RuntimeError("not mine")
        return True

    reg = registry()
    reg.register("noisy", noisy, native=False)
    (flat, errors), _ = dispatched(spark, [("mine", {"custom": ["noisy"]}, None), ("other", {"regex": ["email"]}, None)], registry=reg)
    assert [r.doc_id for r in flat.collect()] == [0] and errors.count() == 0


def test_detectors_run_once(spark):
    texts = spark.createDataFrame([(1, "[1,", '{"file_type": ["json"], "regex": ["[0-9]"]}')], "doc_id long, text string, detector_params string")
    per_row, errors = detect_per_row(texts, ["doc_id"])
    for df, udf in ((errors, "pattern_spans"), (detect(texts, {"file_type": ["json"]}, output="flat"), "json_parses"), (per_row, "pattern_spans"), (per_row_calls(texts, ["doc_id"]), "_plan")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert sum("ArrowEvalPython" in line and f"{udf}(" in line for line in plan.splitlines()) == 1, plan
