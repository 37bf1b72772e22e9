"""Registered queries for per-row dispatch, request shaping and counters
(S2-S4, D1, D3-D5, A1-A6), each with its DuckDB oracle where SQL can say it."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.operators import custom as C
from sievekit.operators import metrics as M
from sievekit.plans.catalog_regex import CUSTOM_PATTERN, RE2, spans_sql
from sievekit.plans.detect import detect
from sievekit.plans.dispatch import FAILED, detect_per_row, per_row_calls
from sievekit.plans.params import names_column
from sievekit.plans.quarantine import checked
from sievekit.session import scratch_path
from sievekit.sources import requests as RQ
from sievekit.sources.tables import table

NV = len(RQ.PARAM_VARIANTS)


# --- D1 normalize_params -------------------------------------------------------


def normalize_params_q(spark, sf_dir):
    r = RQ.params_requests(spark, sf_dir)
    kinds = F.array(*[F.struct(F.lit(k).alias("detector_kind"), names_column(F.col("detector_params"), k).alias("names")) for k in ("regex", "file_type", "custom")])
    each = r.select("doc_id", F.explode(kinds).alias("k"))
    return each.select("doc_id", "k.detector_kind", F.posexplode("k.names").alias("ord", "name"))


def _normalize_sql(kind: str) -> str:
    p = f"$.{kind}"
    return f"""SELECT doc_id, '{kind}' AS kind,
        CASE json_type(detector_params, '{p}')
          WHEN 'VARCHAR' THEN [json_extract_string(detector_params, '{p}')]
          WHEN 'ARRAY' THEN CAST(json_extract_string(detector_params, '{p}[*]') AS VARCHAR[])
          WHEN 'OBJECT' THEN json_keys(detector_params, '{p}')
          ELSE CAST([] AS VARCHAR[]) END AS names
      FROM r"""


NORMALIZE_PARAMS_SQL = f"""
WITH r AS ({RQ.PARAMS_REQUESTS_SQL}),
n AS ({" UNION ALL ".join(_normalize_sql(k) for k in ("regex", "file_type", "custom"))})
SELECT doc_id, kind AS detector_kind, CAST(unnest(range(len(names))) AS INT) AS ord, unnest(names) AS name FROM n WHERE len(names) > 0"""


# --- D3 per_row_dispatch / D5 error_policy -------------------------------------

D3_COLS = ["doc_id", "kind_ord", "detector_kind", "name_ord", "name", "ord", "start", "end", "text", "detection", "detection_type", "score"]


def per_row_dispatch_q(spark, sf_dir):
    flat, _errors = detect_per_row(RQ.params_requests(spark, sf_dir), ["doc_id"])
    return flat.select(*D3_COLS)


def _variant_entries_sql() -> str:
    """(variant, kind_ord, kind, name_ord, name) of the entries that run, per variant, for the oracle."""
    rows = [
        (0, 0, "regex", 0, "email"),
        (1, 0, "regex", 0, "email"), (1, 0, "regex", 1, "ipv4"),
        (2, 0, "regex", 0, "us-phone-number"), (2, 0, "regex", 1, "email"),
        (5, 0, "regex", 0, CUSTOM_PATTERN), (5, 0, "regex", 1, "ipv4"), (5, 1, "custom", 0, "over_100_characters"),
        (6, 0, "file_type", 0, "json"), (6, 1, "regex", 0, "email"),
        (11, 0, "file_type", 0, 'json-with-schema:{"type": "object"}'), (11, 0, "file_type", 1, "json-with-schema:{not json}"),
    ]
    vals = ", ".join(f"({v}, {ko}, '{k}', {no}, '{n}')" for v, ko, k, no, n in rows)
    return f"SELECT * FROM (VALUES {vals}) t(v, kind_ord, detector_kind, name_ord, name)"


def per_row_dispatch_sql() -> str:
    det_sql = []
    for name, (det, typ) in {"email": ("email_address", "pii"), "ipv4": ("ipv4", "pii"), "us-phone-number": ("us-phone-number", "pii")}.items():
        det_sql.append(f"SELECT '{name}' AS nm, * FROM ({spans_sql('SELECT doc_id, text FROM documents', RE2[name], det, typ)})")
    det_sql.append(f"SELECT '{CUSTOM_PATTERN}' AS nm, * FROM ({spans_sql('SELECT doc_id, text FROM documents', CUSTOM_PATTERN, 'custom-regex', 'regex')})")
    det_sql.append(
        "SELECT 'over_100_characters' AS nm, doc_id, 0 AS ord, 0 AS \"start\", CAST(length(text) AS INT) AS \"end\", text,"
        " 'over_100_characters' AS detection, 'over_100_characters' AS detection_type, CAST(1.0 AS DOUBLE) AS score FROM documents WHERE length(text) > 100"
    )
    det_sql.append(
        "SELECT 'json' AS nm, doc_id, 0 AS ord, 0 AS \"start\", CAST(length(text) AS INT) AS \"end\", text,"
        " 'invalid_json' AS detection, 'file_type' AS detection_type, CAST(1.0 AS DOUBLE) AS score FROM documents WHERE NOT coalesce(json_valid(text), false)"
    )
    det_sql.append(
        "SELECT 'json-with-schema:{\"type\": \"object\"}' AS nm, doc_id, 0 AS ord, 0 AS \"start\", CAST(length(text) AS INT) AS \"end\", text,"
        " CASE WHEN NOT coalesce(json_valid(text), false) THEN 'invalid_json' ELSE 'json_schema_mismatch' END AS detection, 'file_type' AS detection_type,"
        " CAST(1.0 AS DOUBLE) AS score FROM documents WHERE NOT coalesce(json_valid(text), false) OR json_type(text) <> 'OBJECT'"
    )
    det_sql.append(
        "SELECT 'json-with-schema:{not json}' AS nm, doc_id, 0 AS ord, 0 AS \"start\","
        " CAST(CASE WHEN NOT coalesce(json_valid(text), false) THEN length(text) ELSE 10 END AS INT) AS \"end\", text,"
        " CASE WHEN NOT coalesce(json_valid(text), false) THEN 'invalid_json' ELSE 'invalid_schema' END AS detection, 'file_type' AS detection_type,"
        " CAST(1.0 AS DOUBLE) AS score FROM documents"
    )
    dets = " UNION ALL ".join(det_sql)
    return f"""
WITH d AS ({dets}),
e AS ({_variant_entries_sql()}),
r AS (SELECT doc_id, CAST(doc_id % {NV} AS INT) AS v FROM documents)
SELECT r.doc_id, CAST(e.kind_ord AS INT) AS kind_ord, e.detector_kind, CAST(e.name_ord AS INT) AS name_ord, e.name,
       d.ord, d."start", d."end", d.text, d.detection, d.detection_type, d.score
FROM r JOIN e ON e.v = r.v JOIN d ON d.doc_id = r.doc_id AND d.nm = e.name"""


def error_policy_q(spark, sf_dir):
    """Quarantine — per-row errors with code and message; the rest of the table runs."""
    _flat, errors = detect_per_row(RQ.params_requests(spark, sf_dir), ["doc_id"])
    return errors


def error_policy_sql() -> str:
    rows = [
        (7, "nosuchkind", None, 400, "Detector nosuchkind not found"),
        (8, "custom", "no_such_function", 400, "Unrecognized custom function: no_such_function"),
        (9, "file_type", "JSON", 400, "Unrecognized file type: JSON"),
        (10, "regex", "[unclosed", 500, f"{FAILED} ({re.error.__name__})"),
    ]
    quoted = lambda x: "NULL" if x is None else f"'{x}'"
    vals = ", ".join(f"({v}, {quoted(k)}, {quoted(n)}, {c}, {quoted(m)})" for v, k, n, c, m in rows)
    return f"""SELECT doc_id, detector_kind, name, CAST(code AS INT) AS code, message
FROM documents JOIN (VALUES {vals}) t(v, detector_kind, name, code, message) ON doc_id % {NV} = v"""


# --- D4 registry_catalogue -----------------------------------------------------


def registry_catalogue_q(spark, sf_dir):
    """Registry (kind, name, doc; JSON docs parsed) with the calls each detector got on documents."""
    reg = spark.createDataFrame(M.registry_rows(), "detector_kind string, detector_name string, doc string")
    reg = reg.withColumn("doc_json", F.try_parse_json("doc")).withColumn("doc_is_json", F.col("doc_json").isNotNull()).drop("doc_json")
    calls = per_row_calls(RQ.params_requests(spark, sf_dir), ["doc_id"])
    used = calls.groupBy("detector_kind", F.col("metric_name").alias("detector_name")).agg(F.count(F.lit(1)).alias("calls"))
    return reg.join(used, ["detector_kind", "detector_name"], "left").select(
        "detector_kind", "detector_name", "doc", "doc_is_json", F.coalesce("calls", F.lit(0)).cast("bigint").alias("calls")
    )


# --- A1 / A4 / A5 counters over per-row requests -------------------------------


def _calls_frame(spark, sf_dir):
    return per_row_calls(RQ.params_requests(spark, sf_dir), ["doc_id"])


def detector_metrics_q(spark, sf_dir):
    calls = _calls_frame(spark, sf_dir).select(
        F.struct(
            F.col("detector_kind"), F.col("metric_name").alias("detector_name"), F.col("hit"),
            F.when(F.col("code").isNotNull(), F.lit("error")).alias("error"),
        ).alias("c")
    )
    return M.detector_metrics(calls.select(F.array("c").alias("calls")), spark)


def _calls_sql() -> str:
    f = f"""SELECT doc_id, text, CAST(doc_id % {NV} AS INT) AS v,
       len(regexp_extract_all(text, '{RE2['email']}')) > 0 AS email_hit,
       len(regexp_extract_all(text, '{RE2['ipv4']}')) > 0 AS ipv4_hit,
       len(regexp_extract_all(text, '{RE2['us-phone-number']}')) > 0 AS phone_hit,
       len(regexp_extract_all(text, '{CUSTOM_PATTERN}')) > 0 AS custom_hit,
       length(text) > 100 AS over100,
       NOT coalesce(json_valid(text), false) AS json_hit
FROM documents"""
    return f"""
WITH f AS ({f}),
c AS (
  SELECT doc_id, 'regex' AS detector_kind, 'email' AS detector_name, email_hit AS hit, 0 AS err FROM f WHERE v IN (0, 1, 2, 6, 7)
  UNION ALL SELECT doc_id, 'regex', 'ipv4', ipv4_hit, 0 FROM f WHERE v IN (1, 5)
  UNION ALL SELECT doc_id, 'regex', 'us-phone-number', phone_hit, 0 FROM f WHERE v = 2
  UNION ALL SELECT doc_id, 'regex', 'custom_regex', custom_hit, 0 FROM f WHERE v = 5
  UNION ALL SELECT doc_id, 'custom', 'over_100_characters', over100, 0 FROM f WHERE v = 5
  UNION ALL SELECT doc_id, 'file_type', 'json', json_hit, 0 FROM f WHERE v = 6
  UNION ALL SELECT doc_id, 'regex', 'custom_regex', false, 1 FROM f WHERE v = 10
  UNION ALL SELECT doc_id, 'file_type', 'json-with-schema', true, 0 FROM f WHERE v = 11
  UNION ALL SELECT doc_id, 'file_type', 'json-with-schema', true, 0 FROM f WHERE v = 11)"""


def _labels_sql() -> str:
    vals = ", ".join(f"('{k}', '{n}')" for k, n in M.metric_label_rows())
    return f"SELECT * FROM (VALUES {vals}) t(detector_kind, detector_name)"


def registry_catalogue_sql() -> str:
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'"
    vals = ", ".join(f"({quoted(k)}, {quoted(n)}, {quoted(d)})" for k, n, d in M.registry_rows())
    return f"""{_calls_sql()},
n AS (SELECT detector_kind, detector_name, count(*) AS calls FROM c GROUP BY ALL),
g AS (SELECT * FROM (VALUES {vals}) t(detector_kind, detector_name, doc))
SELECT g.detector_kind, g.detector_name, doc, doc IS NOT NULL AND json_valid(doc) AS doc_is_json, coalesce(calls, 0) AS calls
FROM g LEFT JOIN n ON g.detector_kind = n.detector_kind AND g.detector_name = n.detector_name"""


def detector_metrics_sql() -> str:
    return f"""{_calls_sql()},
a AS (SELECT detector_kind, detector_name, count(*) AS requests, count(*) FILTER (WHERE hit AND err = 0) AS detections,
             count(*) FILTER (WHERE err = 1) AS errors FROM c GROUP BY ALL),
l AS ({_labels_sql()})
SELECT coalesce(l.detector_kind, a.detector_kind) AS detector_kind, coalesce(l.detector_name, a.detector_name) AS detector_name,
       CAST(coalesce(requests, 0) AS BIGINT) AS requests, CAST(coalesce(detections, 0) AS BIGINT) AS detections,
       CAST(coalesce(errors, 0) AS BIGINT) AS errors
FROM l FULL OUTER JOIN a ON l.detector_kind = a.detector_kind AND l.detector_name = a.detector_name"""


def detection_rate_q(spark, sf_dir):
    return M.detection_rate(detector_metrics_q(spark, sf_dir))


def detection_rate_sql() -> str:
    return f"SELECT *, round(CASE WHEN requests = 0 THEN NULL ELSE detections / requests END, 6) AS detection_rate FROM ({detector_metrics_sql()})"


def bounded_metric_labels_q(spark, sf_dir):
    """A4: user patterns and inline schemas are counted under fixed label names."""
    calls = _calls_frame(spark, sf_dir)
    return calls.groupBy("detector_kind", F.col("metric_name").alias("detector_name")).agg(F.count(F.lit(1)).alias("calls"))


def bounded_metric_labels_sql() -> str:
    return f"""{_calls_sql()}
SELECT detector_kind, detector_name, count(*) AS calls FROM c GROUP BY ALL"""


# --- A2 / A3 / A6 ----------------------------------------------------------------

O_PARAMS = {"regex": ["email", "us-phone-number", "ipv4"], "custom": ["over_100_characters"]}
A_PARAMS = {"regex": ["email", "us-phone-number", "ipv4"], "custom": ["over_100_characters", "contains_word"]}


def observed_counters_q(spark, sf_dir):
    """A1 and U9 from the job that writes the detections, with a counter of the user's for texts of several lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scratch_path(spark, f"observed/{uuid.uuid4().hex}")
    return M.write_counted(docs, O_PARAMS, out, ["doc_id"], user_metrics={"several_lines": F.col("text").contains("\n")})


def observed_counters_sql() -> str:
    hits = {
        ("regex", "email"): f"len(regexp_extract_all(text, '{RE2['email']}')) > 0",
        ("regex", "us-phone-number"): f"len(regexp_extract_all(text, '{RE2['us-phone-number']}')) > 0",
        ("regex", "ipv4"): f"len(regexp_extract_all(text, '{RE2['ipv4']}')) > 0",
        ("custom", "over_100_characters"): "length(text) > 100",
        ("user", "several_lines"): "contains(text, chr(10))",
    }
    counted = " UNION ALL ".join(
        f"SELECT '{kind}' AS detector_kind, '{name}' AS detector_name, count(*) AS requests, count(*) FILTER (WHERE {hit}) AS detections FROM documents"
        for (kind, name), hit in hits.items()
    )
    return f"""WITH a AS ({counted}), l AS ({_labels_sql()})
SELECT coalesce(l.detector_kind, a.detector_kind) AS detector_kind, coalesce(l.detector_name, a.detector_name) AS detector_name,
       CAST(coalesce(requests, 0) AS BIGINT) AS requests, CAST(coalesce(detections, 0) AS BIGINT) AS detections, CAST(0 AS BIGINT) AS errors
FROM l FULL OUTER JOIN a ON l.detector_kind = a.detector_kind AND l.detector_name = a.detector_name"""


def runtime_metrics_q(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return M.runtime_metrics(spark, docs, A_PARAMS)


def request_level_metrics_q(spark, sf_dir):
    """A3: conversations are requests (their turns the contents); a request is a detection if any turn hit."""
    conv = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    d = detect(conv, {"regex": ["email", "us-phone-number"]}, on_error="failfast")
    return M.request_level_metrics(d, "conv_id", "regex", "email+us-phone-number")


def request_level_metrics_sql() -> str:
    return f"""
WITH c AS (SELECT conv_id, max(len(regexp_extract_all(text, '{RE2['email']}')) + len(regexp_extract_all(text, '{RE2['us-phone-number']}')) > 0) AS hit
           FROM conversations GROUP BY conv_id)
SELECT 'regex' AS detector_kind, 'email+us-phone-number' AS detector_name, count(*) AS requests,
       count(*) FILTER (WHERE hit) AS detections, CAST(0 AS BIGINT) AS errors FROM c"""


def content_verdict_q(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = detect(docs, {"regex": ["email", "us-phone-number", "ipv4"], "custom": ["contains_word"]}, on_error="failfast")
    return M.content_verdict(d, ["doc_id"])


def content_verdict_sql() -> str:
    e = f"len(regexp_extract_all(text, '{RE2['email']}'))"
    p = f"len(regexp_extract_all(text, '{RE2['us-phone-number']}'))"
    i = f"len(regexp_extract_all(text, '{RE2['ipv4']}'))"
    w = "CASE WHEN position('apple' IN lower(text)) > 0 THEN 1 ELSE 0 END"
    labels = (
        f"array_to_string(list_sort(list_filter(['email_address', 'ipv4', 'us-phone-number', 'forbidden_word: apple'], "
        f"lambda x: (x = 'email_address' AND {e} > 0) OR (x = 'us-phone-number' AND {p} > 0) OR (x = 'ipv4' AND {i} > 0)"
        f" OR (x = 'forbidden_word: apple' AND {w} > 0))), ',')"
    )
    return f"""
SELECT doc_id, ({e} + {p} + {i} + {w}) > 0 AS flagged, CAST({e} + {p} + {i} + {w} AS INT) AS n_detections, {labels} AS labels
FROM documents"""


# --- S2 / S3 / S4 ------------------------------------------------------------------


def request_quarantine_q(spark, sf_dir):
    """Every body checked in one pass; rejected ones have a code and a message."""
    rows = checked(RQ.request_bodies(spark, sf_dir))
    return rows.select("doc_id", "valid", F.col("code").cast("int").alias("code"), "message", F.when(F.col("valid"), F.size("contents")).alias("n_contents"))


def request_quarantine_sql() -> str:
    b = RQ.body_expr_sql()
    return f"""
WITH r AS (SELECT doc_id, {b} AS body FROM documents),
t AS (SELECT doc_id, body, json_type(body, '$.contents') AS ct, json_type(body, '$.detector_params') AS pt,
             CASE WHEN json_type(body, '$.contents') = 'ARRAY' THEN json_array_length(body, '$.contents') END AS n FROM r),
e AS (SELECT doc_id, n,
        (CASE WHEN ct IS NULL THEN [{{'type': 'missing', 'loc': '''contents'''}}]
              WHEN ct <> 'ARRAY' THEN [{{'type': 'list_type', 'loc': '''contents'''}}]
              WHEN n = 0 THEN [{{'type': 'too_short', 'loc': '''contents'''}}]
              ELSE list_transform(list_filter(range(CAST(n AS BIGINT)), lambda i: json_type(body, '$.contents[' || i || ']') <> 'VARCHAR'),
                                  lambda i: {{'type': 'string_type', 'loc': CAST(i AS VARCHAR)}}) END)
        || (CASE WHEN pt IS NULL THEN [{{'type': 'missing', 'loc': '''detector_params'''}}]
                 WHEN pt = 'NULL' OR pt = 'OBJECT' THEN []
                 ELSE [{{'type': 'dict_type', 'loc': '''detector_params'''}}] END) AS errs
      FROM t)
SELECT doc_id, len(errs) = 0 AS valid, CASE WHEN len(errs) > 0 THEN 422 END AS code,
  CASE WHEN len(errs) = 0 THEN NULL
       WHEN errs[1].type = 'missing' THEN 'Missing required parameters: [' || array_to_string(list_transform(list_filter(errs, lambda x: x.type = 'missing'), lambda x: x.loc), ', ') || ']'
       WHEN suffix(errs[1].type, 'type') THEN 'Parameters with invalid type: [' || array_to_string(list_transform(list_filter(errs, lambda x: suffix(x.type, 'type')), lambda x: x.loc), ', ') || ']'
       ELSE 'Invalid parameters: [' || array_to_string(list_transform(errs, lambda x: x.loc), ', ') || ']' END AS message,
  CASE WHEN len(errs) = 0 THEN CAST(n AS INT) END AS n_contents
FROM e"""


def build() -> dict:
    return {
        "normalize_params": (normalize_params_q, NORMALIZE_PARAMS_SQL),
        "per_row_dispatch": (per_row_dispatch_q, per_row_dispatch_sql()),
        "error_policy": (error_policy_q, error_policy_sql()),
        "registry_catalogue": (registry_catalogue_q, registry_catalogue_sql()),
        "detector_metrics": (detector_metrics_q, detector_metrics_sql()),
        "observed_counters": (observed_counters_q, observed_counters_sql()),
        "runtime_metrics": (runtime_metrics_q, None),
        "request_level_metrics": (request_level_metrics_q, request_level_metrics_sql()),
        "bounded_metric_labels": (bounded_metric_labels_q, bounded_metric_labels_sql()),
        "detection_rate": (detection_rate_q, detection_rate_sql()),
        "content_verdict": (content_verdict_q, content_verdict_sql()),
        "generation_pairs": (RQ.generation_pairs, RQ.GENERATION_PAIRS_SQL),
        "chat_messages": (RQ.chat_messages_flat, RQ.CHAT_MESSAGES_SQL),
        "chat_history": (RQ.chat_history, RQ.CHAT_HISTORY_SQL),
        "request_quarantine": (request_quarantine_q, request_quarantine_sql()),
    }
