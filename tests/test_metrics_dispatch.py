"""Counters, per-row dispatch and request quarantine."""

from pyspark.sql import functions as F

from sievekit.operators import metrics as M
from sievekit.plans.detect import detect
from sievekit.plans.dispatch import detect_per_row, plan_row
from sievekit.plans.quarantine import quarantine


def test_counters_per_content_not_per_hit(spark):
    df = spark.createDataFrame([(0, "a@b.com c@d.com"), (1, "none"), (2, "x@y.org")], "content_id long, text string")
    d = detect(df, {"regex": ["email", "[0-9]+"], "file_type": ["json"]}, with_calls=True)
    m = {(r["detector_kind"], r["detector_name"]): r for r in M.detector_metrics(d).collect()}
    assert (m[("regex", "email")]["requests"], m[("regex", "email")]["detections"]) == (3, 2)
    assert m[("regex", "custom_regex")]["requests"] == 3  # bounded label for a user pattern
    assert m[("file_type", "json")]["detections"] == 3
    assert m[("regex", "ipv4")]["requests"] == 0  # zero-valued series present


def test_plan_row_rules():
    names = ("over_100_characters",)
    assert [e[3] for e in plan_row('{"regex": {"email": {}, "ipv4": 1}}', names)] == ["email", "ipv4"]
    assert plan_row('{"regex": 5}', names) == ()
    assert plan_row('{"nosuch": []}', names)[0][5] == 400
    bad = plan_row('{"regex": ["[", "email"]}', names)
    assert len(bad) == 1 and bad[0][5] == 500  # request stops at its first error
    assert plan_row('{"file_type": ["JSON"]}', names)[0][6] == "Unrecognized file type: JSON"


def test_detect_per_row(spark):
    df = spark.createDataFrame([(0, "a@b.com 1.2.3.4", '{"regex": ["ipv4", "email"]}'), (1, "a@b.com", '{"custom": ["nope"]}')], "doc_id long, text string, detector_params string")
    flat, errors = detect_per_row(df, ["doc_id"])
    assert [(r["doc_id"], r["detection"]) for r in flat.orderBy("name_ord").collect()] == [(0, "ipv4"), (0, "email_address")]
    assert [(r["doc_id"], r["code"]) for r in errors.collect()] == [(1, 400)]


def test_quarantine_messages(spark):
    bodies = [
        (0, '{"contents": ["x"], "detector_params": {}}'),
        (1, '{"detector_params": {}}'),
        (2, '{"contents": "x", "detector_params": {}}'),
        (3, '{"contents": [], "detector_params": {}}'),
        (4, '{"contents": ["a", 1, 2], "detector_params": null}'),
        (5, '{"contents": ["a"]}'),
    ]
    ok, bad = quarantine(spark.createDataFrame(bodies, "doc_id long, body string"))
    assert [r["doc_id"] for r in ok.collect()] == [0]
    msgs = {r["doc_id"]: r["message"] for r in bad.collect()}
    assert msgs[1] == "Missing required parameters: ['contents']"
    assert msgs[2] == "Parameters with invalid type: ['contents']"
    assert msgs[3] == "Invalid parameters: ['contents']"
    assert msgs[4] == "Parameters with invalid type: [1, 2]"
    assert msgs[5] == "Missing required parameters: ['detector_params']"
    assert 0 not in msgs


def test_pairs_bridge_gaps_in_turn_numbers(spark):
    from sievekit.sources.requests import next_turns

    rows = [(1, 0, "user", "a"), (1, 5, "assistant", "b"), (1, 7, "user", "c"), (1, 8, "user", "d"), (1, 5000, "assistant", "e"), (2, 0, "user", "f"), (3, 1, "assistant", "g")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for chunk in (1, 3, 1024):
        got = sorted((r.conv_id, r.turn, r.prompt, r.generated_text) for r in next_turns(df, chunk).collect())
        assert got == [(1, 0, "a", "b"), (1, 8, "d", "e")]
