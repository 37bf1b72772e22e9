"""Request-shaped inputs derived from the driver's tables.

* ``params_requests``: every document paired with one of a fixed set of
  ``detector_params`` JSON strings, chosen by ``doc_id``; exercises per-row
  dispatch (D1, D3, D5, A4) over the whole table.
* ``request_bodies``: JSON request bodies built from documents, some of them
  malformed, for the quarantine split (S4).
* ``generation_pairs`` / ``chat_history``: conversation turns reshaped (S2, S3).
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievekit.sources.tables import table

# Fixed parameter set for per-row dispatch (index = doc_id % len).
PARAM_VARIANTS = [
    '{"regex": "email"}',
    '{"regex": ["email", "ipv4"]}',
    '{"regex": {"us-phone-number": {}, "email": {"x": 1}}}',
    '{"regex": 5}',
    "{}",
    '{"regex": ["[0-9]{3,}[a-z]?", "ipv4", "$CUSTOM_REGEX"], "custom": ["over_100_characters"]}',
    '{"file_type": ["json"], "regex": ["email"]}',
    '{"regex": ["email"], "nosuchkind": ["x"]}',
    '{"custom": ["no_such_function"]}',
    '{"file_type": ["JSON"]}',
    '{"regex": ["[unclosed", "email"]}',
    '{"file_type": ["json-with-schema:{\\"type\\": \\"object\\"}", "json-with-schema:{not json}"]}',
]


def params_expr_spark(id_col: str = "doc_id"):
    arr = F.array(*[F.lit(p) for p in PARAM_VARIANTS])
    return F.element_at(arr, (F.col(id_col) % len(PARAM_VARIANTS) + 1).cast("int"))


def params_expr_sql(id_col: str = "doc_id") -> str:
    items = ", ".join("'" + p.replace("'", "''") + "'" for p in PARAM_VARIANTS)
    return f"([{items}])[CAST({id_col} % {len(PARAM_VARIANTS)} + 1 AS INT)]"


def params_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", params_expr_spark().alias("detector_params"))


PARAMS_REQUESTS_SQL = f"SELECT doc_id, text, {params_expr_sql()} AS detector_params FROM documents"


# --- request bodies for S4 ------------------------------------------------------

BODY_KINDS = 6


def body_expr_spark():
    """Six body shapes by doc_id % 6: valid; missing contents; contents not a
    list; empty contents; non-string items; missing detector_params."""
    text_json = F.to_json(F.array(F.col("text")))
    k = F.col("doc_id") % BODY_KINDS
    ids = F.concat(F.col("doc_id").cast("string"), F.lit(", "), (F.col("doc_id") + 1).cast("string"))
    return (
        F.when(k == 0, F.concat(F.lit('{"contents": '), text_json, F.lit(', "detector_params": {"regex": ["email"]}}')))
        .when(k == 1, F.lit('{"detector_params": {"regex": ["email"]}}'))
        .when(k == 2, F.concat(F.lit('{"contents": "'), F.col("doc_id").cast("string"), F.lit('", "detector_params": {}}')))
        .when(k == 3, F.lit('{"contents": [], "detector_params": 7}'))
        .when(k == 4, F.concat(F.lit('{"contents": ["a", '), ids, F.lit('], "detector_params": null}')))
        .otherwise(F.concat(F.lit('{"contents": '), text_json, F.lit("}")))
    )


def body_expr_sql() -> str:
    k = f"doc_id % {BODY_KINDS}"
    return f"""CASE WHEN {k} = 0 THEN '{{"contents": ' || to_json([text]) || ', "detector_params": {{"regex": ["email"]}}}}'
     WHEN {k} = 1 THEN '{{"detector_params": {{"regex": ["email"]}}}}'
     WHEN {k} = 2 THEN '{{"contents": "' || CAST(doc_id AS VARCHAR) || '", "detector_params": {{}}}}'
     WHEN {k} = 3 THEN '{{"contents": [], "detector_params": 7}}'
     WHEN {k} = 4 THEN '{{"contents": ["a", ' || CAST(doc_id AS VARCHAR) || ', ' || CAST(doc_id + 1 AS VARCHAR) || '], "detector_params": null}}'
     ELSE '{{"contents": ' || to_json([text]) || '}}' END"""


def request_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", body_expr_spark().alias("body"))


# --- requests of 1 to 50 texts for S1 and S5 --------------------------------------
# Every 1,275 documents in order of doc_id make 50 requests, the k-th with k texts; every eleventh
# request has a null among its texts, and every thirteenth repeats the key of its contents.

BATCH = 1275


def request_of(engine: str) -> tuple[str, str]:
    """(request_id, position) of a document, in the SQL of either engine."""
    within = f"(doc_id % {BATCH})"
    kind = "BIGINT"
    nth = f"CAST(floor((sqrt(8.0 * {within} + 1) - 1) / 2) AS {kind})"
    whole = f"CAST(floor(doc_id / {BATCH}.0) AS {kind})"
    return f"({whole} * 50 + {nth})", f"({within} - {nth} * ({nth} + 1) {'div' if engine == 'spark' else '//'} 2)"


def batched_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(request_id, body): JSON requests of several documents each."""
    request, position = request_of("spark")
    docs = table(spark, sf_dir, "documents").select(F.expr(request).alias("request_id"), F.expr(position).alias("position"), "text")
    spelled = F.expr("substring(to_json(array(text)), 2, length(to_json(array(text))) - 2)")
    text = F.when((F.col("request_id") % 11 == 3) & (F.col("position") == 1), F.lit("null")).otherwise(spelled)
    listed = docs.select("request_id", F.struct("position", text.alias("json")).alias("one")).groupBy("request_id").agg(F.sort_array(F.collect_list("one")).alias("ones"))
    texts = F.array_join(F.transform("ones", lambda x: x["json"]), ",")
    twice = F.when(F.col("request_id") % 13 == 5, F.lit('"contents": 7, ')).otherwise(F.lit(""))
    return listed.select("request_id", F.concat(F.lit("{"), twice, F.lit('"contents": ['), texts, F.lit('], "detector_params": {}}')).alias("body"))


def generation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(prompt, generated_text) = a user turn and the conversation's next turn, if an assistant's."""
    return next_turns(table(spark, sf_dir, "conversations"))


def next_turns(conv: DataFrame, chunk: int = 1024) -> DataFrame:
    """Pairs of a user turn and the next turn of its conversation, whatever the gaps in turn numbers.

    Turns are cut into chunks by number, so a conversation with a third of all turns spreads over
    many tasks; the first turn of a conversation's next chunk that has any, found from the few rows
    of (conversation, chunk), stands in for the successor of a chunk's last turn.
    """
    cols = F.struct("turn", "role", "text")
    cut_up = conv.select("conv_id", "turn", "role", "text", F.floor(F.col("turn") / chunk).alias("chunk"), cols.alias("me"))
    heads = cut_up.groupBy("conv_id", "chunk").agg(F.min_by("me", "turn").alias("head"))
    after = Window.partitionBy("conv_id").orderBy("chunk")
    follows = heads.select("conv_id", "chunk", F.lead("head").over(after).alias("beyond"))
    inside = Window.partitionBy("conv_id", "chunk").orderBy("turn")
    paired = cut_up.withColumn("next", F.lead("me").over(inside)).join(follows, ["conv_id", "chunk"], "left")
    paired = paired.withColumn("next", F.coalesce("next", "beyond")).where((F.col("role") == "user") & (F.col("next.role") == "assistant"))
    return paired.select("conv_id", "turn", F.col("text").alias("prompt"), F.col("next.text").alias("generated_text"))


GENERATION_PAIRS_SQL = """
WITH n AS (
  SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text AS prompt, next_text AS generated_text FROM n WHERE role = 'user' AND next_role = 'assistant'"""

ROLES = ["system", "assistant", "user"]


def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: per conversation, the ordered message summary with the role-enum check.

    Aggregates only (partial aggregation): message count, first/last turn,
    invalid roles, role sequence as a compact string ordered by turn is
    avoided on purpose (it would gather a whole conversation in one task);
    the ordered message list stays in the long form ``chat_messages``.
    """
    conv = table(spark, sf_dir, "conversations")
    return conv.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_messages"),
        F.min("turn").alias("first_turn"),
        F.max("turn").alias("last_turn"),
        F.count_if(F.col("role") == "user").alias("n_user"),
        F.count_if(F.col("role") == "assistant").alias("n_assistant"),
        F.count_if(F.col("role") == "system").alias("n_system"),
        F.count_if(~F.coalesce(F.col("role").isin(ROLES), F.lit(False))).alias("n_invalid_role"),
        F.min_by("role", "turn").alias("first_role"),
        F.max_by("role", "turn").alias("last_role"),
    )


CHAT_HISTORY_SQL = """
SELECT conv_id, count(*) AS n_messages, min(turn) AS first_turn, max(turn) AS last_turn,
       count(*) FILTER (WHERE role = 'user') AS n_user, count(*) FILTER (WHERE role = 'assistant') AS n_assistant,
       count(*) FILTER (WHERE role = 'system') AS n_system,
       count(*) FILTER (WHERE NOT coalesce(role IN ('system', 'assistant', 'user'), false)) AS n_invalid_role,
       arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role
FROM conversations GROUP BY conv_id"""


def chat_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form of the chat history: one validated message per row, ordered by (conv_id, turn)."""
    conv = table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", F.struct(F.col("role"), F.col("text").alias("content")).alias("message"), F.col("role").isin(ROLES).alias("valid_role"))


CHAT_MESSAGES_SQL = """SELECT conv_id, turn, role, text AS content, coalesce(role IN ('system', 'assistant', 'user'), false) AS valid_role FROM conversations"""


def chat_messages_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, long form: every message of every conversation, in columns."""
    long = chat_messages(spark, sf_dir)
    return long.select("conv_id", "turn", "message.role", "message.content", F.coalesce("valid_role", F.lit(False)).alias("valid_role"))


# --- classifier params per document (M3, M6, M11-M13) -------------------------

# Fixed parameter set (index = doc_id % len), including the reference tests' bad values.
CLS_PARAM_VARIANTS = [
    "{}",
    '{"threshold": 0.3}',
    '{"threshold": "high"}',
    '{"threshold": true}',
    '{"threshold": []}',
    '{"threshold": null}',
    '{"threshold": 0.25, "label_thresholds": {"toxic": 0.2, "threat": "x", "insult": true}}',
    '{"label_thresholds": [1, 2]}',
    '{"safe_labels": "toxic"}',
    '{"safe_labels": 3}',
    '{"safe_labels": [1, "insult", 3.14, true, ["x"]]}',
    '{"safe_labels": {"a": 1}}',
    '{"max_length": "abc"}',
    '{"max_length": -1}',
    '{"max_length": 0}',
    '{"max_length": 3.5}',
    '{"max_length": true}',
    '{"max_length": false}',
    '{"max_length": []}',
    '{"max_length": {}}',
    '{"max_length": 64, "threshold": 0.35}',
    '{"max_length": 100000}',
    '{"threshold": 0, "safe_labels": [], "max_length": 8}',
    '{"threshold": 1.5}',
]
# Deployment defaults used by the registered queries (the reference reads them from the environment).
CLS_DEFAULTS = {"default_threshold": 0.5, "default_label_thresholds": {"obscene": 0.45}, "default_safe_labels": [0], "default_max_length": 512, "model_max_length": 1024}
TOKEN_DEFAULTS = {"default_threshold": 0.5, "default_label_thresholds": {}, "default_safe_labels": ["O"], "default_max_length": 512, "model_max_length": 1024}


def cls_params_expr_spark(id_col: str = "doc_id"):
    arr = F.array(*[F.lit(p) for p in CLS_PARAM_VARIANTS])
    return F.element_at(arr, (F.col(id_col) % len(CLS_PARAM_VARIANTS) + 1).cast("int"))


def cls_params_expr_sql(id_col: str = "doc_id") -> str:
    items = ", ".join("'" + p.replace("'", "''") + "'" for p in CLS_PARAM_VARIANTS)
    return f"([{items}])[CAST({id_col} % {len(CLS_PARAM_VARIANTS)} + 1 AS INT)]"
