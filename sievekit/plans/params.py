"""Detector parameter normalisation (driver side for a fixed plan, Column side per row)."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("regex", "file_type", "custom")


def normalize_names(params: dict | None, kind: str) -> list:
    """``str`` -> ``[str]``; ``dict`` -> its keys in order; ``list`` -> itself; else ``[]``."""
    if not params or kind not in params:
        return []
    funcs = params[kind]
    if isinstance(funcs, str):
        return [funcs]
    if isinstance(funcs, dict):
        return list(funcs.keys())
    if isinstance(funcs, list):
        return funcs
    return []


def kwargs_for(params: dict, kind: str, name: str) -> dict | None:
    """Per-function kwargs: only when the kind's params are a dict and the value is a dict."""
    funcs = params.get(kind)
    if isinstance(funcs, dict) and isinstance(funcs.get(name), dict):
        return funcs[name]
    return None


def parse_params(params: dict | str | None) -> dict:
    if params is None:
        return {}
    if isinstance(params, str):
        parsed = json.loads(params)
        if not isinstance(parsed, dict):
            raise ValueError("detector_params must be a JSON object")
        return parsed
    return dict(params)


# --- per-row form (D1 over a JSON column) ----------------------------------


def names_column(params_json: Column, kind: str) -> Column:
    """array<string> of requested names for ``kind`` from a per-row JSON params column.

    Same rule as ``normalize_names``: string -> [s]; object -> keys in order;
    array -> its string elements; anything else or absent -> [].
    """
    path = f"$.{kind}"
    raw = F.get_json_object(params_json, path)
    # get_json_object returns a string scalar unquoted and containers as JSON text.
    as_array = F.from_json(raw, "array<string>")
    as_map = F.from_json(raw, "map<string,string>")
    first = F.substring(F.ltrim(raw), 1, 1)
    variant = F.try_parse_json(params_json)
    kind_type = F.schema_of_variant(F.try_variant_get(variant, path, "variant"))
    return (
        F.when(raw.isNull(), F.array().cast("array<string>"))
        .when(kind_type == F.lit("STRING"), F.array(raw))
        .when(first == "[", F.coalesce(as_array, F.array().cast("array<string>")))
        .when(first == "{", F.coalesce(F.map_keys(as_map), F.array().cast("array<string>")))
        .otherwise(F.array().cast("array<string>"))
    )


def value_type(v: Any) -> str:
    if isinstance(v, bool):
        return "bool"
    if isinstance(v, (int, float)):
        return "number"
    if isinstance(v, str):
        return "str"
    if isinstance(v, list):
        return "list"
    if isinstance(v, dict):
        return "dict"
    return "null"


# --- classifier params (M11, M12) -------------------------------------------

NUMERIC_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DECIMAL", "DOUBLE", "FLOAT")
INTEGER_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT")


def _starts_any(t: Column, prefixes) -> Column:
    cond = F.lit(False)
    for p in prefixes:
        cond = cond | t.startswith(p)
    return cond


def resolve_classifier_params(
    params_json: Column,
    default_threshold: float = 0.5,
    default_label_thresholds: dict | None = None,
    default_safe_labels: list | None = None,
    default_max_length: int = 512,
    model_max_length: int | None = None,
) -> Column:
    """Per-row params JSON -> struct<threshold, label_thresholds, safe_keys, max_length>.

    threshold: numeric (not bool) wins, anything else falls back to the default;
    label_thresholds: defaults overlaid by the valid (numeric) request entries;
    safe_labels: defaults UNION the request's str/int items (a bare str/int is
    wrapped; bool, float and nested values dropped; a non-list keeps defaults);
    max_length: positive int or default, clamped to the model maximum
    (1e6 or more means unbounded). Safe labels are JSON-typed keys ('0' vs '"0"').
    """
    import json as _json

    default_label_thresholds = default_label_thresholds or {}
    default_safe_labels = [0] if default_safe_labels is None else default_safe_labels
    v = F.try_parse_json(params_json)

    t_raw = F.try_variant_get(v, "$.threshold", "variant")
    t_type = F.schema_of_variant(t_raw)
    threshold = F.when(_starts_any(t_type, NUMERIC_TYPES), F.try_variant_get(t_raw, "$", "double")).otherwise(F.lit(float(default_threshold)))

    lt_map = F.try_variant_get(v, "$.label_thresholds", "map<string,variant>")
    lt_valid = F.map_filter(F.coalesce(lt_map, F.create_map().cast("map<string,variant>")), lambda k, x: _starts_any(F.schema_of_variant(x), NUMERIC_TYPES))
    lt_req = F.transform_values(lt_valid, lambda k, x: F.try_variant_get(x, "$", "double"))
    if default_label_thresholds:
        d_entries = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(float(x)).alias("value")) for k, x in default_label_thresholds.items()])
        kept = F.filter(d_entries, lambda e: ~F.array_contains(F.map_keys(lt_req), e["key"]))
        label_thresholds = F.map_from_entries(F.concat(kept, F.map_entries(lt_req)))
    else:
        label_thresholds = lt_req

    s_raw = F.try_variant_get(v, "$.safe_labels", "variant")
    s_type = F.schema_of_variant(s_raw)
    d_keys = [_json.dumps(x) for x in default_safe_labels if isinstance(x, (int, str)) and not isinstance(x, bool)]
    defaults = F.array(*[F.lit(k) for k in d_keys]) if d_keys else F.array().cast("array<string>")

    def key_of(x):
        xt = F.schema_of_variant(x)
        return F.when(xt == "STRING", F.to_json(x)).when(_starts_any(xt, INTEGER_TYPES), F.to_json(x))

    items = F.try_variant_get(s_raw, "$", "array<variant>")
    from_list = F.filter(F.transform(items, key_of), lambda k: k.isNotNull())
    req_keys = (
        F.when(s_raw.isNull(), F.array().cast("array<string>"))
        .when((s_type == "STRING") | _starts_any(s_type, INTEGER_TYPES), F.array(F.to_json(s_raw)))
        .when(s_type.startswith("ARRAY"), from_list)
    )
    safe_keys = F.array_sort(F.when(req_keys.isNull(), defaults).otherwise(F.array_union(defaults, req_keys)))

    m_raw = F.try_variant_get(v, "$.max_length", "variant")
    m_type = F.schema_of_variant(m_raw)
    m_val = F.try_variant_get(m_raw, "$", "bigint")
    max_length = F.when(_starts_any(m_type, INTEGER_TYPES) & (m_val > 0), m_val).otherwise(F.lit(default_max_length))
    if model_max_length and model_max_length < 1_000_000:
        max_length = F.least(max_length, F.lit(model_max_length))

    return F.struct(
        threshold.cast("double").alias("threshold"),
        label_thresholds.alias("label_thresholds"),
        safe_keys.alias("safe_keys"),
        max_length.cast("int").alias("max_length"),
    )
