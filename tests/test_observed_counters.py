"""Counters observed on the rows that are written, against counters of their own scan."""

import pytest
from pyspark.sql import functions as F

from sievekit.operators import metrics as M
from sievekit.plans.detect import detect

PARAMS = {"regex": ["email", "[0-9]+", "x+"], "custom": ["over_100_characters"], "file_type": ["json"]}
TEXTS = ["a@b.com 12", "", None, "x" * 120, "sorry\nnothing", "{\"a\": 1}", "a@b.com 12", "y@z.org 4 x", "a " * 60_000 + "m@n.com"]


@pytest.fixture
def texts(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "content_id long, text string, requests string").repartition(4)


def counts(frame):
    return {(r["detector_kind"], r["detector_name"]): (r["requests"], r["detections"], r["errors"]) for r in frame.collect()}


def test_equal_to_counters_of_their_own_scan(spark, texts, tmp_path):
    got = counts(M.write_counted(texts, PARAMS, str(tmp_path / "out"), ["content_id"], user_metrics={"sorry": F.col("text").contains("sorry")}))
    assert got.pop(("user", "sorry")) == (len(TEXTS), 1, 0)
    assert got == counts(M.detector_metrics(detect(texts, PARAMS, with_calls=True), spark))
    assert got["regex", "custom_regex"][0] == 2 * len(TEXTS)
    assert got["regex", "ipv6"] == (0, 0, 0)


def test_written_detections_are_those_of_detect(spark, texts, tmp_path):
    path = str(tmp_path / "out")
    M.write_counted(texts, PARAMS, path, ["content_id"])
    columns = ["content_id", "ord", "start", "end", "text", "detection", "detection_type", "score"]
    key = lambda frame: sorted(map(tuple, frame.select(columns).collect()))
    assert key(spark.read.parquet(path)) == key(detect(texts.drop("requests"), PARAMS, output="flat"))


def test_no_shuffle_and_one_scan(spark, texts, tmp_path):
    source = str(tmp_path / "in")
    texts.write.parquet(source)
    done = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("observed", "observed")
    try:
        M.write_counted(spark.read.schema(texts.schema).parquet(source), PARAMS, str(tmp_path / "out"), ["content_id"])
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    jobs = [done.getJobInfo(j) for j in done.getJobIdsForGroup("observed")]
    assert [len(j.stageIds) for j in jobs] == [1]


@pytest.mark.parametrize("stored", [False, True])
def test_empty_table_gives_zeros(spark, tmp_path, stored):
    empty = spark.createDataFrame([], "content_id long, text string")
    if stored:
        empty.write.parquet(str(tmp_path / "in"))
        empty = spark.read.parquet(str(tmp_path / "in"))
    got = counts(M.write_counted(empty, PARAMS, str(tmp_path / "out"), ["content_id"], user_metrics={"sorry": F.col("text").contains("sorry")}))
    assert set(got.values()) == {(0, 0, 0)} and ("user", "sorry") in got
