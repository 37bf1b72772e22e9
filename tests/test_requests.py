"""Requests of several contents, and partitioned tables."""

import json
import re

import pytest

from sievekit.plans import requests as R
from sievekit.plans.detect import detect

PARAMS = {"regex": ["email", "ipv4"], "custom": ["over_100_characters"]}


def bodies(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "request_id long, body string").repartition(3)


def test_answers_keep_the_order_of_contents(spark):
    texts = [f"no {i}" if i % 3 else f"mail{i}@example.com and 10.0.0.{i}" for i in range(50)]
    sizes = [1, 2, 50, 0, 7]
    made = [json.dumps({"contents": texts[:n], "detector_params": {}}) for n in sizes]
    made.append(json.dumps({"contents": ["", "", "x" * 200, ""], "detector_params": None}))
    got = {r["request_id"]: r["response"] for r in R.answers(R.checked(bodies(spark, made)), PARAMS).collect()}
    assert sorted(got) == [0, 1, 2, 4, 5]  # an empty list of contents is not a request
    for i, n in enumerate(sizes[:3]):
        spans = [[(d["detection"], d["text"]) for d in one] for one in got[i]]
        assert spans == [[("email_address", f"mail{k}@example.com"), ("ipv4", f"10.0.0.{k}")] if k % 3 == 0 else [] for k in range(n)]
    assert [len(one) for one in got[5]] == [0, 0, 1, 0]


def test_rejected_requests(spark):
    made = [
        None, "", "{", "[]", '{"contents": ["a", null], "detector_params": {}}', '{"contents": [1, "a"], "detector_params": {}}',
        '{"contents": ["a"], "contents": ["b", "c"], "detector_params": {}, "x": 1}', '{"contents": ["a"]}', '{"contents": "a", "detector_params": 3}',
    ]
    got = {r["request_id"]: r for r in R.checked(bodies(spark, made)).collect()}
    assert [i for i in got if got[i]["valid"]] == [6] and got[6]["contents"] == ["b", "c"] and got[6]["code"] is None
    assert all(got[i]["code"] == 422 and got[i]["message"] and got[i]["contents"] is None for i in got if i != 6)
    assert got[4]["message"] == "Parameters with invalid type: [1]" and got[7]["message"] == "Missing required parameters: ['detector_params']"


def test_empty_tables(spark):
    none = R.checked(bodies(spark, []).limit(0))
    assert R.answers(none, PARAMS).count() == 0 and R.contents_of(none).count() == 0


def scans(df):
    return len(re.findall(r"FileScan parquet", df._jdf.queryExecution().executedPlan().toString()))


def test_bodies_are_read_in_one_scan(spark, tmp_path):
    bodies(spark, ['{"contents": ["a"], "detector_params": {}}', "{"]).write.parquet(str(tmp_path / "in"))
    assert scans(R.checked(spark.read.parquet(str(tmp_path / "in")))) == 1


@pytest.mark.parametrize("by", ["detection_type"])
def test_detections_by_type(spark, tmp_path, by):
    path = str(tmp_path / "out")
    docs = spark.createDataFrame([(i, f"a{i}@example.com " + "x" * (i % 2) * 120) for i in range(400)], "doc_id long, text string")
    flat = detect(docs, PARAMS, output="flat").drop("metadata")
    # Small files are joined at run time; here the dealing itself is looked at.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    R.write_detections(flat, path, writers=4)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    back = spark.read.parquet(path)
    assert sorted(map(str, back.select(flat.columns).collect())) == sorted(map(str, flat.collect()))
    one = back.where("detection_type = 'pii'")
    assert re.search(r"PartitionFilters: \[[^\]]*detection_type[^\]]* = pii", one._jdf.queryExecution().executedPlan().toString())
    # The common type is written by several tasks.
    assert len(list((tmp_path / "out" / "detection_type=pii").glob("*.parquet"))) > 1
    # Only folders with new rows are replaced.
    R.write_detections(flat.where("detection_type = 'pii' AND doc_id < 3"), path)
    again = spark.read.parquet(path).groupBy("detection_type").count().collect()
    assert {r[0]: r[1] for r in again} == {"pii": 3, "over_100_characters": 200}


def test_requests_by_validity(spark, tmp_path):
    path = str(tmp_path / "out")
    R.write_requests(R.checked(bodies(spark, ['{"contents": ["a"], "detector_params": {}}', "{", "{"])), path)
    bad = spark.read.parquet(path).where("NOT valid")
    assert bad.count() == 2 and "PartitionFilters: [" in bad._jdf.queryExecution().executedPlan().toString()
