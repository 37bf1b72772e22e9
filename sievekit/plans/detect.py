"""The detection entry point: ``detect(df, params)``.

A fixed plan (one ``params`` dict for the whole DataFrame) is resolved on the
driver and becomes ONE projection: every requested detector is a Column
expression producing ``array<Detection>``, concatenated in request order
(kind order, then function order, then match order). No shuffle, no join; the
same call works on a streaming DataFrame.

Per-row plans (each row carries its own JSON params) are in ``detect_per_row``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.operators import custom as C
from sievekit.operators import filetype as FT
from sievekit.operators import regex as RX
from sievekit.plans.params import KINDS, kwargs_for, normalize_names, parse_params
from sievekit.schema import DETECTIONS, flatten
from sievekit.session import bound_batches

CALL = T.StructType(
    [
        T.StructField("detector_kind", T.StringType()),
        T.StructField("detector_name", T.StringType()),
        T.StructField("hit", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass
class PlannedCall:
    kind: str
    metric_name: str  # bounded label (custom patterns / schemas collapsed)
    detections: Column  # array<Detection>
    error: Column | None  # string or null


def plan(params: dict | str | None, text: Column, registry: C.CustomRegistry | None = None, headers: Column | None = None, on_error: str = "quarantine") -> list[PlannedCall]:
    """Resolve a request's params into Column expressions (driver side, once)."""
    params = parse_params(params)
    registry = registry or C.example_registry()
    calls: list[PlannedCall] = []
    for kind in params:
        if kind not in KINDS:
            raise ValueError(f"Detector {kind} not found")
        names = normalize_names(params, kind)
        if kind == "regex":
            for it in RX.plan_regex(names):
                calls.append(PlannedCall(kind, it.metric_name, it.builder(text), None))
        elif kind == "file_type":
            for _name, metric, builder in FT.plan_file_types(names):
                calls.append(PlannedCall(kind, metric, builder(text), None))
        else:
            for name in names:
                res = C.custom_result(registry, name, text, headers, kwargs_for(params, kind, name), failfast=(on_error == "failfast"))
                calls.append(PlannedCall(kind, name, C.as_array(res), res["error"]))
    return calls


def detections_column(calls: list[PlannedCall]) -> Column:
    if not calls:
        return F.array().cast(DETECTIONS)
    cols = [c.detections for c in calls]
    return cols[0] if len(cols) == 1 else F.concat(*cols)


def calls_column(calls: list[PlannedCall]) -> Column:
    """array<struct<detector_kind, detector_name, hit, error>>: one entry per detector call (for counters)."""
    if not calls:
        return F.array().cast(T.ArrayType(CALL))
    return F.array(
        *[
            F.struct(
                F.lit(c.kind).alias("detector_kind"),
                F.lit(c.metric_name).alias("detector_name"),
                (F.size(c.detections) > 0).alias("hit"),
                (c.error if c.error is not None else F.lit(None).cast("string")).alias("error"),
            )
            for c in calls
        ]
    )


def detect(
    df: DataFrame,
    params: dict | str | None,
    text_col: str = "text",
    output: str = "nested",
    on_error: str = "quarantine",
    registry: C.CustomRegistry | None = None,
    headers_col: str | None = None,
    with_calls: bool = False,
) -> DataFrame:
    """Add ``detections`` (nested) or return one row per detection (flat).

    ``on_error="quarantine"`` keeps going and records per-row ``errors``;
    ``"failfast"`` raises inside the job like the reference's 500.
    """
    bound_batches(df.sparkSession)
    text = F.col(text_col)
    headers = F.col(headers_col) if headers_col else None
    calls = plan(params, text, registry, headers, on_error)
    # Materialise each detector's array once; the concat and the per-call
    # counters below then reference it instead of re-running the regex.
    staged = df.select(
        "*",
        *[F.when(text.isNotNull(), c.detections).otherwise(F.array().cast(DETECTIONS)).alias(f"__d{i}") for i, c in enumerate(calls)],
        *[(c.error if c.error is not None else F.lit(None).cast("string")).alias(f"__e{i}") for i, c in enumerate(calls)],
    )
    refs = [PlannedCall(c.kind, c.metric_name, F.col(f"__d{i}"), F.col(f"__e{i}")) for i, c in enumerate(calls)]
    out = staged.withColumn("detections", detections_column(refs))
    if with_calls or on_error == "quarantine":
        call_col = calls_column(refs)
        if with_calls:
            out = out.withColumn("calls", call_col)
        errs = F.filter(call_col, lambda c: c["error"].isNotNull())
        out = out.withColumn(
            "errors",
            F.transform(errs, lambda c: F.struct(c["detector_kind"].alias("detector_kind"), c["detector_name"].alias("detector_name"), c["error"].alias("message"))),
        )
    out = out.drop(*[f"__d{i}" for i in range(len(calls))], *[f"__e{i}" for i in range(len(calls))])
    if output == "flat":
        keep = [c for c in df.columns if c != text_col]
        return flatten(out.select(*keep, "detections"), "detections", keep)
    return out


def split_errors(detected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quarantine: (rows without errors, rows with errors as code 500 + message)."""
    ok = detected.where(F.size("errors") == 0)
    bad = detected.where(F.size("errors") > 0).withColumn(
        "error",
        F.struct(F.lit(500).alias("code"), F.lit("Detection error, check detector logs").alias("message")),
    )
    return ok, bad
