"""Templates are filled in one pass."""

from pyspark.sql import functions as F

from sievekit.operators.judge import render_template


def test_values_are_not_expanded_again(spark):
    rows = [("{a}-{b}-{c}{a}", {"a": "{b}", "b": "x"}), ("none", {"a": "1"}), ("{a}", {"a": None}), ("{", {"a": "1"}), ("$1{a}\\", {"a": "$0"})]
    df = spark.createDataFrame(rows, "t string, v map<string,string>").select(render_template(F.col("t"), F.col("v")).alias("r"))
    assert [r.r for r in df.collect()] == ["{b}-x-{c}{b}", "none", "", "{", "$1$0\\"]
