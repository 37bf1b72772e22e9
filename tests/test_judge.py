"""Judge: parameter defaults and errors, score fallback, catalogue, templates."""

import pytest
from pyspark.sql import functions as F

from sievekit.operators import judge as J


def test_params_by_row(spark):
    """Defaults, forced scales and unknown metrics; null params are empty ones."""
    rows = [None, "{}", '{"criteria": "is it kind"}', '{"criteria": "c", "scale": [1, 5]}', '{"metric": "safety", "scale": [2, 9]}', '{"metric": "nope"}']
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, p string")
    got = [tuple(r["v"]) for r in df.select("i", J.validate_params_column(F.coalesce("p", F.lit("{}"))).alias("v")).orderBy("i").collect()]
    safety = ("safety", None, None, None, None)
    assert got[:5] == [safety, safety, (None, "is it kind", 0.0, 1.0, None), (None, "c", 1.0, 5.0, None), ("safety", None, 0.0, 1.0, None)]
    assert got[5][-1] == "Metric 'nope' not found"


def test_score_fallback(spark):
    df = spark.createDataFrame([("8.5", True, 8.5), ("8.5", True, None), ("GOOD", False, None), ("true", False, None)], "d string, n boolean, s double")
    got = [r[0] for r in df.select(J.judge_score(F.col("d"), F.col("n"), F.col("s"))).collect()]
    assert got == [8.5, 8.5, 0.0, 0.0]


def test_catalogue_sorted_31(spark):
    names = [r["metric"] for r in J.metric_catalogue(spark).collect()]
    assert len(names) == 31 and names == sorted(names)


def test_template(spark):
    df = spark.createDataFrame([("Rate {x} and {y} {z}",)], "t string")
    out = df.select(J.render_template(F.col("t"), F.create_map(F.lit("x"), F.lit("A"), F.lit("y"), F.lit("B")))).collect()[0][0]
    assert out == "Rate A and B {z}"


def test_run_stub_judge(spark):
    df = spark.createDataFrame([(1, "a b c", None, "safety", None, 0.0, 1.0), (2, "a b", None, None, "crit", 0.0, 1.0)],
                               "id long, content string, input string, metric string, criteria string, scale_min double, scale_max double")
    res = {r["id"]: r for r in J.run_judge(df, J.stub_judge, ["id"]).collect()}
    assert res[1]["decision"] == "safe" and res[1]["score"] is None
    assert res[2]["decision"] == "0.1" and res[2]["decision_is_numeric"]
