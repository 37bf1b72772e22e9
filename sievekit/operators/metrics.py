"""Counters and rates over detection results.

All counters are plain aggregates with map-side partial aggregation, so a
detector or request key holding a third of the rows costs one pre-aggregated
row per task, never a hot reducer. Dense output (zero-valued series present)
comes from a left join of the small, fixed registry onto the aggregate; both
sides are bounded by the number of registered detectors.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.operators import custom as C
from sievekit.operators import filetype as FT
from sievekit.operators import regex as RX
from sievekit.schema import flatten

METRIC_COLUMNS = ["detector_kind", "detector_name", "requests", "detections", "errors"]


def registry_rows(registry: C.CustomRegistry | None = None) -> list[tuple[str, str, str]]:
    """(kind, name, doc) of every registered detector, with the bounded metric names."""
    registry = registry or C.example_registry()
    rows = [("regex", n, RX.REGEX_DOCS[n]) for n in RX.REGEX_NAMES]
    rows.append(("regex", RX.CUSTOM_REGEX_PLACEHOLDER, RX.REGEX_DOCS[RX.CUSTOM_REGEX_PLACEHOLDER]))
    rows += [("file_type", n, FT.FILE_TYPE_DOCS[n]) for n in FT.FILE_TYPE_REGISTRY]
    rows += [("custom", n, registry.get(n).doc) for n in registry.names()]
    return rows


def metric_label_rows(registry: C.CustomRegistry | None = None) -> list[tuple[str, str]]:
    """Every (kind, metric name) a counter can carry (bounded label set)."""
    registry = registry or C.example_registry()
    rows = [("regex", n) for n in RX.REGEX_NAMES] + [("regex", RX.CUSTOM_REGEX_METRIC_NAME)]
    rows += [("file_type", n) for n in ("json", "xml", "yaml", "json-with-schema", "xml-with-schema", "yaml-with-schema")]
    rows += [("custom", n) for n in registry.names()]
    return rows


def labels_frame(spark: SparkSession, registry: C.CustomRegistry | None = None) -> DataFrame:
    return spark.createDataFrame(metric_label_rows(registry), "detector_kind string, detector_name string")


def detector_metrics(detected: DataFrame, spark: SparkSession | None = None, dense: bool = True, registry: C.CustomRegistry | None = None) -> DataFrame:
    """A1: requests, detections, errors per (kind, name) from ``detect(..., with_calls=True)``.

    +1 request per content per function; +1 detection when that call had at
    least one hit; an error counts as a request and an error, not a detection.
    """
    calls = detected.select(F.explode("calls").alias("c")).select("c.*")
    agg = calls.groupBy("detector_kind", "detector_name").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("hit") & F.col("error").isNull()).alias("detections"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    if not dense:
        return agg
    spark = spark or detected.sparkSession
    labels = labels_frame(spark, registry)
    # both sides are bounded by the registry size; the label table is a literal
    return (
        labels.join(agg, ["detector_kind", "detector_name"], "full_outer")
        .select(
            "detector_kind",
            "detector_name",
            F.coalesce("requests", F.lit(0)).cast("bigint").alias("requests"),
            F.coalesce("detections", F.lit(0)).cast("bigint").alias("detections"),
            F.coalesce("errors", F.lit(0)).cast("bigint").alias("errors"),
        )
    )


def _times(condition: Column) -> Column:
    return F.count(F.when(condition, F.lit(1)))


def write_counted(
    df: DataFrame,
    params: dict,
    path: str,
    key_cols: list[str],
    text_col: str = "text",
    registry: C.CustomRegistry | None = None,
    user_metrics: dict[str, Column] | None = None,
) -> DataFrame:
    """A1/U9 by observation: writes the flat detections by type and returns the counters of that same job.

    The counters are gathered while the rows pass by on their way to the files, so they need no
    scan, shuffle or second run of a detector. The job has no shuffle, and its one stage counts each
    partition once, whatever tasks are run again; that is why hot types aren't dealt to writers here
    as ``write_detections`` does, and each task writes its own file of a type.

    ``user_metrics`` are conditions over the columns of ``df`` by name; rows that meet one are its
    detections, and its kind is ``user``. A null text is a request without a detection, an empty
    table gives zeros, calls of one label (two patterns of a user) are added up. Rows come back to the
    driver for labels only, at most one for each call, registered detector and user metric.
    """
    from sievekit.plans.detect import detect, plan

    labels = [(c.kind, c.metric_name) for c in plan(params, F.col(text_col), registry)]
    user = {f"_user{i}": (name, condition) for i, (name, condition) in enumerate((user_metrics or {}).items())}
    rows = df.select("*", *[condition.alias(c) for c, (_, condition) in user.items()])
    detected = detect(rows, params, text_col, registry=registry, with_calls=True)
    counts = [F.count(F.lit(1)).alias("requests")]
    for i in range(len(labels)):
        call = F.col("calls")[i]
        counts.append(_times(call["hit"] & call["error"].isNull()).alias(f"detections{i}"))
        counts.append(_times(call["error"].isNotNull()).alias(f"errors{i}"))
    counts += [_times(F.col(c)).alias(c) for c in user]
    seen = Observation()
    passed = detected.observe(seen, *counts).select(*key_cols, "detections")
    flatten(passed, "detections", key_cols).write.mode("overwrite").partitionBy("detection_type").parquet(path)

    got = seen.get
    series = {label: [0, 0, 0] for label in metric_label_rows(registry)}
    for i, label in enumerate(labels):
        total = series.setdefault(label, [0, 0, 0])
        for k, n in enumerate((got["requests"], got[f"detections{i}"], got[f"errors{i}"])):
            total[k] += n
    for c, (name, _) in user.items():
        series["user", name] = [got["requests"], got[c], 0]
    schema = "detector_kind string, detector_name string, requests bigint, detections bigint, errors bigint"
    return df.sparkSession.createDataFrame([(*label, *total) for label, total in series.items()], schema)


def detection_rate(metrics: DataFrame) -> DataFrame:
    """A5: share of requests with a detection."""
    return metrics.withColumn("detection_rate", F.round(F.try_divide(F.col("detections").cast("double"), F.col("requests").cast("double")), 6))


def request_level_metrics(detected: DataFrame, request_col: str, kind: str, name: str) -> DataFrame:
    """A3: one request = many contents; a request is a detection if any content hit."""
    per_req = detected.groupBy(request_col).agg(F.max(F.size("detections") > 0).alias("hit"))
    return per_req.agg(
        F.lit(kind).alias("detector_kind"),
        F.lit(name).alias("detector_name"),
        F.count(F.lit(1)).alias("requests"),
        F.count_if("hit").alias("detections"),
        F.lit(0).cast("bigint").alias("errors"),
    )


def content_verdict(detected: DataFrame, key_cols: list[str]) -> DataFrame:
    """Did any detector fire on this content."""
    return detected.select(
        *key_cols,
        F.exists("detections", lambda d: F.lit(True)).alias("flagged"),
        F.size("detections").alias("n_detections"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("detections", lambda d: d["detection"]))), ",").alias("labels"),
    )


RUNTIME = T.StructType(
    [T.StructField("detector_kind", T.StringType()), T.StructField("detector_name", T.StringType()), T.StructField("rows", T.LongType()), T.StructField("runtime_s", T.DoubleType())]
)


def runtime_metrics(spark: SparkSession, df: DataFrame, params: dict, text_col: str = "text") -> DataFrame:
    """A2: wall seconds per detector, each detector run as its own full scan.

    Spark has no per-expression timer, so every requested detector is executed
    alone (a distributed job over all rows, results aggregated on executors);
    only the elapsed time per job is measured on the driver.
    """
    from sievekit.plans.detect import plan

    rows = []
    for call in plan(params, F.col(text_col)):
        t0 = time.time()
        n = df.select(F.size(call.detections).alias("n")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n")).collect()[0]["rows"]
        rows.append((call.kind, call.metric_name, int(n), round(time.time() - t0, 6)))
    return spark.createDataFrame(rows, RUNTIME)
