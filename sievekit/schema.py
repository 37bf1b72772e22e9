"""Detection data model as Spark types.

A detection is one struct; a content's result is ``array<Detection>`` (empty
array when nothing fired, never null); the flat form is one row per detection.
Offsets are code-point indices, half open, like Python string slicing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVIDENCE = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("evidence", T.StructType([T.StructField("source", T.StringType())])),
    ]
)

DETECTION = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("detection", T.StringType()),
        T.StructField("detection_type", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("evidences", T.ArrayType(EVIDENCE)),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

DETECTIONS = T.ArrayType(DETECTION)

SPAN = T.StructType(
    [
        T.StructField("start", T.IntegerType()),
        T.StructField("end", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)
SPANS = T.ArrayType(SPAN)

ERROR = T.StructType([T.StructField("code", T.IntegerType()), T.StructField("message", T.StringType())])

# Flat detection columns, in output order.
FLAT_COLUMNS = ["start", "end", "text", "detection", "detection_type", "score"]

DEFAULT_DETECTION_NAME = "detection"


def empty_detections() -> Column:
    return F.array().cast(DETECTIONS)


def empty_metadata() -> Column:
    return F.create_map().cast(T.MapType(T.StringType(), T.StringType()))


def detection_struct(
    start: Column,
    end: Column,
    text: Column,
    detection: Column | str,
    detection_type: Column | str,
    score: Column | float = 1.0,
    evidences: Column | None = None,
    metadata: Column | None = None,
) -> Column:
    """Build one Detection struct from columns or literals."""

    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    return F.struct(
        lit(start).cast("int").alias("start"),
        lit(end).cast("int").alias("end"),
        lit(text).cast("string").alias("text"),
        lit(detection).cast("string").alias("detection"),
        lit(detection_type).cast("string").alias("detection_type"),
        lit(score).cast("double").alias("score"),
        (evidences if evidences is not None else F.lit(None)).cast(T.ArrayType(EVIDENCE)).alias("evidences"),
        (metadata if metadata is not None else empty_metadata()).cast(T.MapType(T.StringType(), T.StringType())).alias("metadata"),
    )


def spans_to_detections(spans: Column, detection: str, detection_type: str, score: float = 1.0) -> Column:
    """array<Span> -> array<Detection> with fixed name/type/score."""
    return F.transform(
        spans,
        lambda s: detection_struct(s["start"], s["end"], s["text"], detection, detection_type, score),
    )


def whole_text_detection(text: Column, detection: Column | str, detection_type: Column | str, score: Column | float = 1.0) -> Column:
    """A detection whose span is the whole text (file types, custom bools, classifiers)."""
    return detection_struct(F.lit(0), F.length(text), text, detection, detection_type, score)


def posexploded(df, keep: list, array: Column, name: str):
    """One row per element of ``array``, with its place ``ord``; its elements are never null.

    Of an inner explode Spark infers a filter on the array's size, which it pushes below the projection
    that makes the array: every detector would run twice.
    """
    return df.select(*keep, F.posexplode_outer(array).alias("ord", name)).where(F.col("ord").isNotNull())


def flatten(df, detections_col: str = "detections", keep: list[str] | None = None):
    """Nested -> flat: one row per detection, with ``ord`` = position in the array."""
    keep = keep or [c for c in df.columns if c != detections_col]
    return posexploded(df, keep, F.col(detections_col), "d").select(*keep, "ord", *[F.col("d")[c].alias(c) for c in FLAT_COLUMNS], F.col("d")["metadata"].alias("metadata"))
