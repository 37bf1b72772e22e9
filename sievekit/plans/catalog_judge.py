"""Registered queries for judge-based scoring (J1-J6), run with the deterministic stub judge."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.operators import judge as J
from sievekit.sources.requests import generation_pairs
from sievekit.sources.tables import table

# Fixed per-document judge params (index = doc_id % len).
JUDGE_PARAM_VARIANTS = [
    "{}",
    '{"metric": "safety"}',
    '{"criteria": "Is the text clear?"}',
    '{"metric": "clarity", "scale": [1, 5]}',
    '{"metric": "no_such_metric"}',
    '{"criteria": "Rate the tone", "scale": [0, 10]}',
]
NJ = len(JUDGE_PARAM_VARIANTS)


def _params_col(id_col="doc_id"):
    arr = F.array(*[F.lit(p) for p in JUDGE_PARAM_VARIANTS])
    return F.element_at(arr, (F.col(id_col) % NJ + 1).cast("int"))


def _params_sql(id_col="doc_id") -> str:
    items = ", ".join("'" + p.replace("'", "''") + "'" for p in JUDGE_PARAM_VARIANTS)
    return f"([{items}])[CAST({id_col} % {NJ} + 1 AS INT)]"


def _validated(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", "text", J.validate_params_column(_params_col()).alias("p"))


def judge_params_q(spark, sf_dir):
    v = _validated(spark, sf_dir)
    return v.select("doc_id", "p.metric", "p.criteria", "p.scale_min", "p.scale_max", "p.error")


def _judge_params_sql() -> str:
    names = ", ".join(f"'{m}'" for m in J.METRIC_NAMES)
    return f"""
WITH r AS (SELECT doc_id, text, {_params_sql()} AS p FROM documents),
f AS (SELECT *, json_exists(p, '$.metric') AS hm, json_exists(p, '$.criteria') AS hc, json_exists(p, '$.scale') AS hs,
             json_extract_string(p, '$.metric') AS m FROM r)
SELECT doc_id, text,
  CASE WHEN NOT hm AND NOT hc THEN 'safety' ELSE m END AS metric,
  json_extract_string(p, '$.criteria') AS criteria,
  CASE WHEN (hm AND m IN ({names})) OR (NOT hm AND hc AND NOT hs) THEN 0.0 ELSE CAST(json_extract(p, '$.scale[0]') AS DOUBLE) END AS scale_min,
  CASE WHEN (hm AND m IN ({names})) OR (NOT hm AND hc AND NOT hs) THEN 1.0 ELSE CAST(json_extract(p, '$.scale[1]') AS DOUBLE) END AS scale_max,
  CASE WHEN hm AND NOT coalesce(m IN ({names}), false) THEN 'Metric ''' || m || ''' not found' END AS error
FROM f"""


JUDGE_PARAMS_SQL = f"SELECT doc_id, metric, criteria, scale_min, scale_max, error FROM ({_judge_params_sql()})"


def _results(spark, sf_dir):
    v = _validated(spark, sf_dir).where(F.col("p.error").isNull())
    inp = v.select("doc_id", F.length("text").alias("n_chars"), F.col("text").alias("content"), F.lit(None).cast("string").alias("input"), "p.metric", "p.criteria", "p.scale_min", "p.scale_max")
    return J.run_judge(inp, J.stub_judge, ["doc_id", "n_chars"])


def _stub_sql(src: str, n_expr: str) -> str:
    """The stub judge's rule in SQL over ``src`` (needs metric, criteria columns)."""
    return f"""SELECT *, {n_expr} AS n,
  CASE WHEN criteria IS NOT NULL AND metric IS NULL THEN CAST(({n_expr}) % 11 / 10.0 AS VARCHAR)
       WHEN metric = 'safety' THEN CASE WHEN ({n_expr}) % 3 = 0 THEN 'unsafe' ELSE 'safe' END
       ELSE CASE WHEN ({n_expr}) % 2 = 0 THEN 'GOOD' ELSE 'BAD' END END AS decision,
  (criteria IS NOT NULL AND metric IS NULL) AS decision_is_numeric,
  CASE WHEN (criteria IS NULL OR metric IS NOT NULL) AND metric = 'safety' AND ({n_expr}) % 3 = 0 THEN CAST(0.9 AS DOUBLE) END AS raw_score,
  CAST({n_expr} AS VARCHAR) || ' spaces' AS reasoning
FROM {src}"""


SPACES = "(length(text) - length(replace(text, ' ', '')))"


def judge_contents_q(spark, sf_dir):
    """One verdict per content, always emitted (requests with an unknown metric are quarantined)."""
    res = _results(spark, sf_dir)
    d = J.judge_detections(res, ["doc_id", "n_chars"])
    return d.select("doc_id", F.lit(0).alias("start"), F.col("n_chars").cast("int").alias("end"), "detection", "detection_type", "score", F.col("metadata")["reasoning"].alias("reasoning"))


def judge_contents_sql() -> str:
    return f"""
WITH v AS ({_judge_params_sql()}),
s AS ({_stub_sql('(SELECT * FROM v WHERE error IS NULL)', SPACES)})
SELECT doc_id, 0 AS "start", CAST(length(text) AS INT) AS "end", decision AS detection, 'llm_judge' AS detection_type,
       coalesce(raw_score, CASE WHEN decision_is_numeric THEN CAST(decision AS DOUBLE) END, 0.0) AS score, reasoning FROM s"""


def judge_score_q(spark, sf_dir):
    """Score if present, else numeric decision, else 0.0."""
    res = _results(spark, sf_dir)
    return res.select("doc_id", "decision", "decision_is_numeric", F.col("score").alias("raw_score"), J.judge_score(F.col("decision"), F.col("decision_is_numeric"), F.col("score")).alias("score"))


def judge_score_sql() -> str:
    return f"""
WITH v AS ({_judge_params_sql()}),
s AS ({_stub_sql('(SELECT * FROM v WHERE error IS NULL)', SPACES)})
SELECT doc_id, decision, decision_is_numeric, raw_score,
       coalesce(raw_score, CASE WHEN decision_is_numeric THEN CAST(decision AS DOUBLE) END, 0.0) AS score FROM s"""


def judge_generations_q(spark, sf_dir):
    """(prompt, response) pairs judged with the prompt as ``input``; no span in the result."""
    pairs = generation_pairs(spark, sf_dir)
    inp = pairs.select(
        "conv_id", "turn", F.col("generated_text").alias("content"), F.col("prompt").alias("input"),
        F.lit("safety").alias("metric"), F.lit(None).cast("string").alias("criteria"), F.lit(0.0).alias("scale_min"), F.lit(1.0).alias("scale_max"),
    )
    res = J.run_judge(inp, J.stub_judge, ["conv_id", "turn"])
    d = J.judge_detections(res, ["conv_id", "turn"])
    return d.select("conv_id", "turn", "detection", "detection_type", "score", F.col("metadata")["reasoning"].alias("reasoning"))


def judge_generations_sql() -> str:
    from sievekit.sources.requests import GENERATION_PAIRS_SQL

    n = "(length(generated_text) - length(replace(generated_text, ' ', '')) + length(prompt) - length(replace(prompt, ' ', '')))"
    return f"""
WITH g AS (SELECT *, 'safety' AS metric, CAST(NULL AS VARCHAR) AS criteria FROM ({GENERATION_PAIRS_SQL})),
s AS ({_stub_sql('g', n)})
SELECT conv_id, turn, decision AS detection, 'llm_judge' AS detection_type,
       coalesce(raw_score, CASE WHEN decision_is_numeric THEN CAST(decision AS DOUBLE) END, 0.0) AS score, reasoning FROM s"""


def judge_metric_catalogue_q(spark, sf_dir):
    """Sorted metric names, total, and how many requests asked for each."""
    cat = J.metric_catalogue(spark)
    used = _validated(spark, sf_dir).groupBy(F.col("p.metric").alias("metric")).agg(F.count(F.lit(1)).alias("requests"))
    return cat.join(used, "metric", "left").select(
        "metric", F.coalesce("requests", F.lit(0)).cast("bigint").alias("requests"), F.lit(len(J.METRIC_NAMES)).alias("total")
    )


def judge_metric_catalogue_sql() -> str:
    vals = ", ".join(f"('{m}')" for m in J.METRIC_NAMES)
    return f"""
WITH c AS (SELECT * FROM (VALUES {vals}) t(metric)),
u AS (SELECT metric, count(*) AS requests FROM ({_judge_params_sql()}) GROUP BY metric)
SELECT c.metric, CAST(coalesce(u.requests, 0) AS BIGINT) AS requests, {len(J.METRIC_NAMES)} AS total FROM c LEFT JOIN u ON u.metric = c.metric"""


TEMPLATE = "Is this {lang} text from {source} ({n} chars) safe? Unknown: {other}"


def judge_prompt_columns_q(spark, sf_dir):
    """Judge request columns; ``{name}`` placeholders filled from per-row template vars."""
    docs = table(spark, sf_dir, "documents")
    vars_ = F.create_map(F.lit("lang"), F.col("lang"), F.lit("source"), F.col("source"), F.lit("n"), F.length("text").cast("string"))
    return docs.select(
        "doc_id",
        J.render_template(F.lit(TEMPLATE), vars_).alias("criteria"),
        F.lit("safety").alias("metric"),
        F.lit(0.0).alias("scale_min"),
        F.lit(1.0).alias("scale_max"),
    )


JUDGE_PROMPT_SQL = f"""
SELECT doc_id,
  replace(replace(replace('{TEMPLATE}', '{{lang}}', coalesce(lang, '')), '{{source}}', coalesce(source, '')), '{{n}}', CAST(length(text) AS VARCHAR)) AS criteria,
  'safety' AS metric, CAST(0.0 AS DOUBLE) AS scale_min, CAST(1.0 AS DOUBLE) AS scale_max
FROM documents"""


def build() -> dict:
    return {
        "judge_contents": (judge_contents_q, judge_contents_sql()),
        "judge_generations": (judge_generations_q, judge_generations_sql()),
        "judge_params": (judge_params_q, JUDGE_PARAMS_SQL),
        "judge_score": (judge_score_q, judge_score_sql()),
        "judge_metric_catalogue": (judge_metric_catalogue_q, judge_metric_catalogue_sql()),
        "judge_prompt_columns": (judge_prompt_columns_q, JUDGE_PROMPT_SQL),
    }
