"""Judge-based scoring.

The judge is a pluggable batch callable ``judge(batch: pandas.DataFrame) ->
pandas.DataFrame``: input columns ``content``, ``input`` (prompt or null),
``metric``, ``criteria``, ``scale_min``, ``scale_max``; output columns
``decision`` (string), ``decision_is_numeric`` (bool), ``score`` (float or
null), ``reasoning`` (string). A remote client lives inside the callable and
is created once per Python worker; Spark runs it partition by partition in
``mapInPandas``. Parameter validation, score fallback and the detection rows
are native Column work around it.
"""

from __future__ import annotations

from typing import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The judge backend's built-in metric names as documented by the
# reference (sorted), and the detection type.
METRIC_NAMES = [
    "accuracy", "agent_performance_template", "api_docs_template", "appropriate", "bias_detection", "clarity",
    "code_quality", "code_review_template", "code_security", "coherence", "conciseness", "creativity",
    "customer_service_template", "educational_content_template", "educational_value", "factual", "helpfulness",
    "legal_appropriateness", "llama_guard_3_safety", "medical_accuracy", "medical_info_template", "preference",
    "product_review_template", "professionalism", "rag_evaluation_template", "relevance", "safety",
    "summarization_quality", "toxicity", "translation_quality", "writing_quality_template",
]
DETECTION_TYPE = "llm_judge"
DEFAULT_METRIC = "safety"
DEFAULT_SCALE = (0, 1)

RESULT_FIELDS = [
    T.StructField("decision", T.StringType()),
    T.StructField("decision_is_numeric", T.BooleanType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("reasoning", T.StringType()),
]


def metric_catalogue(spark, scales: dict | None = None) -> DataFrame:
    """J5 base table: metric name and its own scale (null when the backend defines none)."""
    scales = scales or {}
    rows = [(m, *(scales.get(m) or (None, None))) for m in METRIC_NAMES]
    return spark.createDataFrame(rows, "metric string, scale_min double, scale_max double")


def validate_params_column(params_json: Column, scales: dict | None = None) -> Column:
    """J3 per row: struct<metric, criteria, scale_min, scale_max, error> from a params JSON column."""
    scales = scales or {}
    v = F.try_parse_json(params_json)
    metric = F.try_variant_get(v, "$.metric", "string")
    criteria = F.try_variant_get(v, "$.criteria", "string")
    has_metric = F.try_variant_get(v, "$.metric", "variant").isNotNull()
    has_criteria = F.try_variant_get(v, "$.criteria", "variant").isNotNull()
    has_scale = F.try_variant_get(v, "$.scale", "variant").isNotNull()
    s_min = F.try_variant_get(v, "$.scale[0]", "double")
    s_max = F.try_variant_get(v, "$.scale[1]", "double")
    known = metric.isin(METRIC_NAMES)
    own = [m for m in METRIC_NAMES if scales.get(m) is not None]
    own_scale = metric.isin(own) if own else F.lit(False)
    out_metric = F.when(~has_metric & ~has_criteria, F.lit(DEFAULT_METRIC)).otherwise(metric)
    force = (has_metric & known & ~own_scale) | (~has_metric & has_criteria & ~has_scale)
    out_min = F.when(force, F.lit(float(DEFAULT_SCALE[0]))).otherwise(s_min)
    out_max = F.when(force, F.lit(float(DEFAULT_SCALE[1]))).otherwise(s_max)
    error = F.when(has_metric & ~F.coalesce(known, F.lit(False)), F.concat(F.lit("Metric '"), metric, F.lit("' not found")))
    return F.struct(
        out_metric.alias("metric"), criteria.alias("criteria"), out_min.alias("scale_min"), out_max.alias("scale_max"), error.alias("error")
    )


def judge_score(decision: Column, decision_is_numeric: Column, score: Column) -> Column:
    """Score if present, else the numeric decision, else 0.0."""
    return F.when(score.isNotNull(), score).when(decision_is_numeric, decision.cast("double")).otherwise(F.lit(0.0))


def run_judge(df: DataFrame, judge: Callable[[pd.DataFrame], pd.DataFrame], key_cols: list[str]) -> DataFrame:
    """Call the judge per Arrow batch; ``df`` has key columns + content/input/metric/criteria/scale_min/scale_max."""
    in_cols = ["content", "input", "metric", "criteria", "scale_min", "scale_max"]
    key_fields = [f for f in df.schema.fields if f.name in key_cols]
    schema = T.StructType(key_fields + RESULT_FIELDS)

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            res = judge(b[in_cols].reset_index(drop=True))
            out = pd.concat([b[key_cols].reset_index(drop=True), res[["decision", "decision_is_numeric", "score", "reasoning"]]], axis=1)
            yield out

    return df.select(*key_cols, *in_cols).mapInPandas(apply, schema)


def judge_detections(results: DataFrame, key_cols: list[str]) -> DataFrame:
    """J1 rows: decision as name, type llm_judge, fallback score, reasoning in metadata."""
    return results.select(
        *key_cols,
        F.col("decision").alias("detection"),
        F.lit(DETECTION_TYPE).alias("detection_type"),
        judge_score(F.col("decision"), F.col("decision_is_numeric"), F.col("score")).alias("score"),
        F.create_map(F.lit("reasoning"), F.col("reasoning")).alias("metadata"),
    )


def render_template(template: Column, variables: Column) -> Column:
    """Replace ``{name}`` placeholders from a map<string,string> (format-style, no engine)."""
    name = r"\{([^{}]*)\}"
    gaps, names = F.split(template, name, -1), F.regexp_extract_all(template, F.lit(name), F.lit(1))

    def filled(key: Column) -> Column:
        """The value of a known name; an unknown placeholder stays."""
        return F.when(F.map_contains_key(variables, key), F.coalesce(F.try_element_at(variables, key), F.lit(""))).otherwise(F.concat(F.lit("{"), key, F.lit("}")))

    # One pass over the template: values that hold placeholders themselves are not expanded.
    return F.array_join(F.flatten(F.zip_with(gaps, names, lambda g, k: F.when(k.isNull(), F.array(g)).otherwise(F.array(g, filled(k))))), "")


# --- deterministic stub judge for tests and the registered queries -------------


def stub_judge(batch: pd.DataFrame) -> pd.DataFrame:
    """Deterministic stand-in for a remote judge.

    n = number of spaces in content (+ input). Custom criteria -> numeric
    decision (n % 11) / 10 without score; metric ``safety`` -> ``unsafe`` with
    score 0.9 when n % 3 == 0, else ``safe`` without score (falls back to 0.0);
    other metrics -> ``GOOD``/``BAD`` without score.
    """
    rows = []
    for content, inp, metric, criteria in zip(batch["content"], batch["input"], batch["metric"], batch["criteria"]):
        n = (content or "").count(" ") + ((inp or "").count(" ") if isinstance(inp, str) else 0)
        if isinstance(criteria, str) and not isinstance(metric, str):
            d = (n % 11) / 10
            rows.append((str(d), True, None, f"{n} spaces"))
        elif metric == "safety":
            if n % 3 == 0:
                rows.append(("unsafe", False, 0.9, f"{n} spaces"))
            else:
                rows.append(("safe", False, None, f"{n} spaces"))
        else:
            rows.append(("GOOD" if n % 2 == 0 else "BAD", False, None, f"{n} spaces"))
    return pd.DataFrame(rows, columns=["decision", "decision_is_numeric", "score", "reasoning"])
