"""Per-row dispatch: every row carries its own ``detector_params`` JSON.

1. The params of a row are planned once per distinct params string inside an Arrow
   batch: a small helper gives the ordered calls (kind, name, argument, kwargs) or the
   error at which the request stops.
2. One projection evaluates each detector on the rows whose plan names it: a detector's
   text is null elsewhere, so its Python function or parser never sees other rows. User
   patterns and inline schemas are data: a row passes arrays of its own.
3. Calls then pick their results by name or place. No explode or shuffle happens before
   the result, so a row's errors are at hand in the row itself.

A request stops at its first error, whether found while planning (unknown kind, name or
file type, a name that is no string, a pattern that doesn't compile) or while running (a
user function that raises, a schema that makes no sense): it yields one error row and no
detections. XSDs, which Spark compiles with the query, are given as ``xsds``.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from sievekit.functions.spans import _finditer_rows, let
from sievekit.operators import custom as C
from sievekit.operators import filetype as FT
from sievekit.operators import regex as RX
from sievekit.plans.params import KINDS, kwargs_for, normalize_names
from sievekit.schema import DETECTIONS, FLAT_COLUMNS, SPANS, detection_struct, posexploded, spans_to_detections, whole_text_detection
from sievekit.session import bound_batches

CALL_FIELDS = "kind_ord int, detector_kind string, name_ord int, name string, metric_name string, code int, message string, arg string, slot int, kwargs string"
PLAN = f"array<struct<{', '.join(f.replace(' ', ':') for f in CALL_FIELDS.split(', '))}>>"
_KEYS = [f.split()[0] for f in CALL_FIELDS.split(", ")]

BUILTIN_FILE_TYPES = ("json", "xml", "yaml")
SCHEMA_PREFIXES = ("json-with-schema", "yaml-with-schema", "xml-with-schema")
FAILED = "Detection error, check detector logs"


@lru_cache(maxsize=4096)
def plan_row(params_json: str | None, custom_names: tuple[str, ...], xsds: tuple[str, ...] = ()) -> tuple:
    """Calls of one params string, each a tuple of CALL_FIELDS; the last one may carry an error."""
    if params_json is None:
        return ()

    def stop(k_ord, kind, n_ord, name, metric, code, message):
        return (k_ord, kind, n_ord, name if isinstance(name, str) else None, metric, code, message, None, None, None)

    try:
        params = json.loads(params_json)
    except (ValueError, RecursionError):
        return (stop(0, None, 0, None, None, 422, "Invalid parameters: ['detector_params']"),)
    if not isinstance(params, dict):
        return (stop(0, None, 0, None, None, 422, "Parameters with invalid type: ['detector_params']"),)
    out, patterns, schemas = [], 0, 0
    for k_ord, kind in enumerate(params):
        if kind not in KINDS:
            return (*out, stop(k_ord, kind, 0, None, None, 400, f"Detector {kind} not found"))
        for n_ord, name in enumerate(normalize_names(params, kind)):
            error = lambda metric, code, message: (*out, stop(k_ord, kind, n_ord, name, metric, code, message))  # noqa: B023, E731
            arg, slot, metric = None, None, name
            if not isinstance(name, str):
                if kind == "regex":
                    return error(RX.CUSTOM_REGEX_METRIC_NAME, 500, f"{FAILED} ({type(name).__name__} is no pattern)")
                what = "file type" if kind == "file_type" else "custom function"
                return error("invalid_file_type" if kind == "file_type" else None, 400, f"Unrecognized {what}: {name}")
            if kind == "regex":
                if name == RX.CUSTOM_REGEX_PLACEHOLDER:
                    continue
                if name not in RX.SPAN_BUILDERS:
                    metric = RX.CUSTOM_REGEX_METRIC_NAME
                    try:
                        re.compile(name)
                    except (re.error, RecursionError, OverflowError) as e:
                        return error(metric, 500, f"{FAILED} ({type(e).__name__})")
                    slot, patterns = patterns, patterns + 1
            elif kind == "file_type":
                prefix = next((p for p in SCHEMA_PREFIXES if name.startswith(p)), None)
                if prefix is not None:
                    metric = prefix
                    if f"{prefix}:" not in name:
                        return error(metric, 500, FAILED)
                    arg = name.split(f"{prefix}:")[1]
                    if prefix == "xml-with-schema":
                        if arg not in xsds:
                            return error(metric, 400, "This XSD is not registered with the query")
                    else:
                        slot, schemas = schemas, schemas + 1
                elif name not in BUILTIN_FILE_TYPES:
                    return error("invalid_file_type", 400, f"Unrecognized file type: {name}")
            elif name not in custom_names:
                return error(name, 400, f"Unrecognized custom function: {name}")
            given = kwargs_for(params, kind, name) if kind == "custom" else None
            out.append((k_ord, kind, n_ord, name, metric, None, None, arg, slot, None if given is None else json.dumps(given)))
    return tuple(out)


def plan_column(params: Column, registry: C.CustomRegistry, xsds: tuple[str, ...] = ()) -> Column:
    names = tuple(registry.names())

    @pandas_udf(PLAN)
    def _plan(ps: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(_KEYS, e, strict=True)) for e in plan_row(p, names, xsds)] for p in ps], dtype=object)

    return _plan(params)


@pandas_udf(T.ArrayType(SPANS))
def pattern_spans(texts: pd.Series, patterns: pd.Series) -> pd.Series:
    """Spans of each of a row's own patterns, in their order."""
    return pd.Series(
        [[] if t is None or p is None else [_finditer_rows(pd.Series([t]), x, 0).iloc[0] for x in p] for t, p in zip(texts, patterns, strict=True)],
        dtype=object,
    )


@pandas_udf(T.ArrayType(T.StringType()))
def schema_outcomes(texts: pd.Series, names: pd.Series) -> pd.Series:
    """For each inline schema of a row: ok, invalid, mismatch, bad_schema or failed."""
    return pd.Series([[] if t is None or n is None else [FT.schema_outcome(t, x) for x in n] for t, n in zip(texts, names, strict=True)], dtype=object)


def _result(dets: Column, error: Column | None = None) -> Column:
    return F.struct(dets.alias("dets"), (F.lit(None).cast("string") if error is None else error).alias("error"))


def _named(kind: str, name: str) -> Callable[[Column], Column]:
    return lambda e: (e["detector_kind"] == kind) & (e["name"] == name) & e["code"].isNull()


def evaluated(
    df: DataFrame, key_cols: list[str], params_col: str, text_col: str, registry: C.CustomRegistry, headers_col: str | None, xsds: tuple[str, ...]
) -> DataFrame:
    """(keys, calls): every row's calls up to its first error, each with ``dets`` and ``error``."""
    bound_batches(df.sparkSession)
    extra = [headers_col] if headers_col else []
    planned = df.select(*key_cols, text_col, *extra, plan_column(F.col(params_col), registry, xsds).alias("_plan"))
    text = F.col(text_col)
    by_name: dict[tuple[str, str], str] = {}
    texts, columns = [], []

    def add(kind: str, name: str, make) -> None:
        # Null text where the call isn't wanted: neither Java nor Python works on it.
        n = len(texts)
        texts.append(F.when(F.exists("_plan", _named(kind, name)), text).alias(f"_t{n}"))
        by_name[kind, name] = f"_r{n}"
        columns.append(make(F.col(f"_t{n}")).alias(f"_r{n}"))

    for name, spans in RX.SPAN_BUILDERS.items():
        detection, kind = RX.REGEX_NAMES[name]
        add("regex", name, lambda t, s=spans, d=detection, k=kind: F.when(t.isNotNull(), _result(spans_to_detections(s(t), d, k))))
    for name, detect in (("json", FT.json_detection), ("yaml", FT.yaml_detection), ("xml", FT.xml_detection)):
        add("file_type", name, lambda t, d=detect: F.when(t.isNotNull(), _result(d(t))))
    for xsd in xsds:
        name = f"xml-with-schema:{xsd}"
        add("file_type", name, lambda t, n=name: F.when(t.isNotNull(), _result(FT.plan_file_types([n])[0][2](t))))
    headers = F.col(headers_col) if headers_col else None
    for name in registry.names():
        given = F.get(F.filter("_plan", _named("custom", name)), F.lit(0))["kwargs"]
        add("custom", name, lambda t, n=name, g=given: _custom(registry, n, t, headers, g))
    own = F.filter("_plan", lambda e: e["metric_name"] == RX.CUSTOM_REGEX_METRIC_NAME)
    patterns = F.transform(F.filter(own, lambda e: e["code"].isNull()), lambda e: e["name"])
    inline = F.transform(F.filter("_plan", lambda e: e["slot"].isNotNull() & (e["detector_kind"] == "file_type")), lambda e: e["name"])
    columns.append(pattern_spans(F.when(F.size("_patterns") > 0, text), F.col("_patterns")).alias("_spans"))
    columns.append(schema_outcomes(F.when(F.size("_inline") > 0, text), F.col("_inline")).alias("_schemas"))
    staged = planned.select("*", *texts, patterns.alias("_patterns"), inline.alias("_inline"))
    results = staged.select(*key_cols, text_col, "_plan", *columns)

    def answer(e: Column) -> Column:
        out = _result(F.array().cast(DETECTIONS))
        spans = F.coalesce(F.get("_spans", e["slot"]), F.array().cast(SPANS))
        is_pattern = (e["detector_kind"] == "regex") & e["slot"].isNotNull()
        out = F.when(is_pattern, _result(spans_to_detections(spans, RX.CUSTOM_REGEX_DETECTION, RX.CUSTOM_REGEX_TYPE))).otherwise(out)
        is_schema = (e["detector_kind"] == "file_type") & e["slot"].isNotNull()
        out = F.when(is_schema, _schema_answer(F.get("_schemas", e["slot"]), e, text)).otherwise(out)
        for (kind, name), column in by_name.items():
            out = F.when((e["detector_kind"] == kind) & (e["name"] == name) & F.col(column).isNotNull(), F.col(column)).otherwise(out)
        return out

    def call(e: Column) -> Column:
        def finished(got: Column) -> Column:
            error = F.when(e["code"].isNotNull(), e["message"]).otherwise(got["error"])
            code = F.when(e["code"].isNotNull(), e["code"]).when(got["error"].isNotNull(), F.lit(500))
            fields = [e[k].alias(k) for k in ("kind_ord", "detector_kind", "name_ord", "name", "metric_name")]
            return F.struct(*fields, code.alias("code"), error.alias("message"), got["dets"].alias("dets"))

        return let(answer(e), finished)

    calls = results.select(*key_cols, F.transform("_plan", call).alias("_calls"))
    first_error = F.array_position(F.transform("_calls", lambda c: c["code"].isNotNull()), True)
    reached = F.when(first_error > 0, first_error).otherwise(F.size("_calls")).cast("int")
    return calls.select(*key_cols, F.slice("_calls", 1, reached).alias("calls"))


def _custom(registry: C.CustomRegistry, name: str, text: Column, headers: Column | None, kwargs: Column) -> Column:
    res = C.per_row_result(registry, name, text, headers, kwargs)
    error = F.when(res["error"].isNotNull(), F.concat(F.lit(f"{FAILED} ("), res["error"], F.lit(")")))
    return F.when(text.isNotNull(), _result(C.as_array(res), error))


def _schema_answer(outcome: Column, e: Column, text: Column) -> Column:
    is_yaml = e["metric_name"] == "yaml-with-schema"
    whole = lambda names: whole_text_detection(text, F.when(is_yaml, names[1]).otherwise(names[0]), FT.FILE_TYPE)
    bad = detection_struct(F.lit(0), F.length(e["arg"]), text, FT.INVALID_SCHEMA, FT.FILE_TYPE, 1.0)
    dets = (
        F.when(outcome == "invalid", F.array(whole((FT.INVALID_JSON, FT.INVALID_YAML))))
        .when(outcome == "mismatch", F.array(whole((FT.JSON_SCHEMA_MISMATCH, FT.YAML_SCHEMA_MISMATCH))))
        .when(outcome == "bad_schema", F.array(bad))
        .otherwise(F.array().cast(DETECTIONS))
    )
    return _result(dets, F.when(outcome == "failed", F.lit(FAILED)))


def detect_per_row(
    df: DataFrame,
    key_cols: list[str],
    params_col: str = "detector_params",
    text_col: str = "text",
    registry: C.CustomRegistry | None = None,
    headers_col: str | None = None,
    on_error: str = "quarantine",
    xsds: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Returns (flat detections, errors). A row with an error contributes one error row and no detections.

    ``on_error="failfast"`` raises in the job at the first row with an error.
    """
    done = evaluated(df, key_cols, params_col, text_col, registry or C.example_registry(), headers_col, xsds)
    failed = F.exists("calls", lambda c: c["code"].isNotNull())
    if on_error == "failfast":
        last = F.element_at("calls", -1)
        done = done.withColumn("calls", F.when(~failed, F.col("calls")).otherwise(F.raise_error(last["message"])))
    none = F.slice("calls", 1, 0)
    errors = posexploded(done, key_cols, F.when(failed, F.slice("calls", -1, 1)).otherwise(none), "c")
    errors = errors.select(*key_cols, *[F.col(f"c.{k}").alias(k) for k in ("detector_kind", "name", "code", "message")])
    entries = posexploded(done, key_cols, F.when(~failed, F.col("calls")).otherwise(none), "c").drop("ord")
    flat = posexploded(entries, [*key_cols, "c.kind_ord", "c.detector_kind", "c.name_ord", "c.name"], F.col("c.dets"), "d")
    flat = flat.select(*key_cols, "kind_ord", "detector_kind", "name_ord", "name", "ord", *[F.col("d")[c].alias(c) for c in FLAT_COLUMNS])
    return flat, errors


def per_row_calls(
    df: DataFrame, key_cols: list[str], params_col: str = "detector_params", text_col: str = "text",
    registry: C.CustomRegistry | None = None, headers_col: str | None = None, xsds: tuple[str, ...] = (),
) -> DataFrame:
    """One row per (content, detector call) with hit and error code, for counters (A1, A4).

    A failing call (500) counts as request and error; requests rejected for what they name (400)
    move no counter of the rejected call.
    """
    done = evaluated(df, key_cols, params_col, text_col, registry or C.example_registry(), headers_col, xsds)
    calls = posexploded(done, key_cols, F.col("calls"), "c").where(F.col("c.code").isNull() | (F.col("c.code") == 500))
    hit = F.col("c.code").isNull() & (F.size("c.dets") > 0)
    return calls.select(*key_cols, "c.detector_kind", "c.metric_name", hit.alias("hit"), "c.code")
