"""Registered queries for sources, fan-out and regex detectors (S*, D2, R*),
each with the DuckDB SQL that must give the same rows.

DuckDB runs RE2: no backreferences (separators are spelled out), no
lookarounds, ASCII ``\\b``/``\\d``. The oracle patterns below are the RE2
spellings of the reference patterns; on the driver's tables they select the
same matches (checked by the differential tests against Python ``re``).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.plans import requests as RB
from sievekit.plans.detect import detect
from sievekit.session import scratch_path
from sievekit.sources import requests as RQ
from sievekit.sources.tables import scan_input, scan_input_sql, table

FLAT = ["doc_id", "ord", "start", "end", "text", "detection", "detection_type", "score"]

# The detectors' patterns, spelled for RE2 (same matches as the Python patterns on the test tables).
RE2 = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "credit-card": (
        r"\b(?:4\d{3} \d{4} \d{4} \d{4}|4\d{3}-\d{4}-\d{4}-\d{4}|4\d{15}"
        r"|5[1-5]\d{2} \d{4} \d{4} \d{4}|5[1-5]\d{2}-\d{4}-\d{4}-\d{4}|5[1-5]\d{14}"
        r"|3[47]\d{2} \d{6} \d{5}|3[47]\d{2}-\d{6}-\d{5}|3[47]\d{13}"
        r"|6(?:011|5\d{2}) \d{4} \d{4} \d{4}|6(?:011|5\d{2})-\d{4}-\d{4}-\d{4}|6(?:011|5\d{2})\d{12}"
        r"|3(?:0[0-5]|[68]\d)\d \d{6} \d{4}|3(?:0[0-5]|[68]\d)\d-\d{6}-\d{4}|3(?:0[0-5]|[68]\d)\d{11}"
        r"|35\d{2} \d{4} \d{4} \d{4}|35\d{2}-\d{4}-\d{4}-\d{4}|35\d{14})\b"
    ),
    "ipv4": (
        r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
        r"\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
    ),
    "ipv6": r"\s*(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}\s*",
    "us-social-security-number": r"\b\d{3}[- ]\d{2}[- ]\d{4}\b",
    "us-phone-number": r"(?:\+?1[-.\s]?)?(?:\(\d{3}\)|\d{3})[-.\s]+\d{3}[-.\s]?\d{4}\b",
    "uk-post-code": r"\b([A-Z]{1,2}[0-9][0-9A-Z]? ?[0-9][A-Z]{2})\b",
}
NAMES = {
    "email": ("email_address", "pii"),
    "credit-card": ("credit_card", "pii"),
    "ipv4": ("ipv4", "pii"),
    "ipv6": ("ipv6", "pii"),
    "us-social-security-number": ("social_security_number", "pii"),
    "us-phone-number": ("us-phone-number", "pii"),
    "uk-post-code": ("uk-post-code", "pii"),
}
# which derived fixture rows each detector's query adds to documents
FIXTURE_FOR = {
    "email": [],
    "credit-card": ["card"],
    "ipv4": [],
    "ipv6": ["ipv6"],
    "us-social-security-number": ["ssn"],
    "us-phone-number": [],
    "uk-post-code": ["postcode"],
}
CUSTOM_PATTERN = r"[0-9]{3,}[a-z]?"  # R0/R8 query pattern (same meaning in Python, Java and RE2)

LUHN_SQL = """(list_sum(list_transform(range(length({d})), lambda k:
    CASE WHEN k % 2 = 0 THEN CAST(substr(reverse({d}), k + 1, 1) AS INT)
         WHEN 2 * CAST(substr(reverse({d}), k + 1, 1) AS INT) > 9 THEN 2 * CAST(substr(reverse({d}), k + 1, 1) AS INT) - 9
         ELSE 2 * CAST(substr(reverse({d}), k + 1, 1) AS INT) END)) % 10)"""


def luhn_sql(expr: str) -> str:
    d = f"regexp_replace({expr}, '[^0-9]', '', 'g')"
    return "coalesce(" + LUHN_SQL.format(d=d) + ", 0)"


def spans_sql(src_sql: str, pattern: str, detection: str, dtype: str, luhn: bool = False, extra_cols: str = "") -> str:
    """Flat spans in DuckDB: matches + split gaps, offsets from cumulative lengths."""
    keep = "WHERE " + ("(" + luhn_sql("t") + ") = 0" if luhn else "TRUE")
    return f"""
WITH src AS ({src_sql}),
m AS (SELECT doc_id{extra_cols}, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gs
      FROM src WHERE text IS NOT NULL),
e AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM m WHERE len(ms) > 0),
s AS (SELECT doc_id{extra_cols}, i, ms[i] AS t,
             CAST(list_sum(list_transform(gs[1:i], lambda x: length(x)))
                  + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS INT) AS st
      FROM e),
k AS (SELECT * FROM s {keep})
SELECT doc_id{extra_cols}, CAST(row_number() OVER (PARTITION BY doc_id{extra_cols} ORDER BY i) - 1 AS INT) AS ord,
       st AS "start", CAST(st + length(t) AS INT) AS "end", t AS text,
       '{detection}' AS detection, '{dtype}' AS detection_type, CAST(1.0 AS DOUBLE) AS score
FROM k"""


def _flat_regex(spark: SparkSession, sf_dir: str, names: list[str], kinds: list[str]) -> DataFrame:
    df = scan_input(spark, sf_dir, kinds)
    return detect(df, {"regex": names}, output="flat", on_error="failfast").select(*FLAT)


def regex_query(name: str):
    def q(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat_regex(spark, sf_dir, [name], FIXTURE_FOR[name])

    return q


def regex_oracle(name: str) -> str:
    det, typ = NAMES[name]
    return spans_sql(scan_input_sql(FIXTURE_FOR[name]), RE2[name], det, typ, luhn=(name == "credit-card"))


# --- flagship: emails per language -----------------------------------------


def email_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emails in documents per language: hits, documents hit, share of documents hit.

    One scan and a partial aggregate on ``lang``; languages without hits stay.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    d = detect(docs, {"regex": ["email"]}, on_error="failfast")
    n = F.size("detections")
    return d.groupBy("lang").agg(
        F.count(F.lit(1)).alias("documents"),
        F.count_if(n > 0).alias("documents_hit"),
        F.sum(n).cast("bigint").alias("hits"),
        F.round(F.count_if(n > 0) / F.count(F.lit(1)), 6).alias("share_hit"),
    )


EMAIL_BY_LANG_SQL = f"""
SELECT lang, count(*) AS documents,
       count(*) FILTER (WHERE len(regexp_extract_all(text, '{RE2["email"]}')) > 0) AS documents_hit,
       CAST(sum(len(regexp_extract_all(text, '{RE2["email"]}'))) AS BIGINT) AS hits,
       round(count(*) FILTER (WHERE len(regexp_extract_all(text, '{RE2["email"]}')) > 0) / count(*), 6) AS share_hit
FROM documents GROUP BY lang"""


# --- R0 / R8 / R9 / R10 ----------------------------------------------------


def regex_spans_q(spark, sf_dir):
    """Generic span extraction of one pattern (native path)."""
    from sievekit.functions.spans import regex_spans
    from sievekit.schema import spans_to_detections

    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = df.select("doc_id", F.posexplode(spans_to_detections(regex_spans(F.col("text"), CUSTOM_PATTERN), "custom-regex", "regex")).alias("ord", "d"))
    return d.select("doc_id", "ord", *[F.col("d")[c].alias(c) for c in FLAT[2:]])


def custom_regex_q(spark, sf_dir):
    """An unregistered name in a request is a user pattern."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return detect(df, {"regex": [CUSTOM_PATTERN, "$CUSTOM_REGEX"]}, output="flat", on_error="failfast").select(*FLAT)


MULTI = ["email", "us-phone-number", "ipv4", "credit-card", "us-social-security-number", "uk-post-code"]
MULTI_FIXTURES = ["card", "ssn", "postcode"]


def regex_multi_q(spark, sf_dir):
    """Several names in one request; results in request order, then match order."""
    return _flat_regex(spark, sf_dir, MULTI, MULTI_FIXTURES)


def regex_multi_sql() -> str:
    parts = []
    for k, name in enumerate(MULTI):
        det, typ = NAMES[name]
        parts.append(f"SELECT {k} AS fk, * FROM ({spans_sql(scan_input_sql(MULTI_FIXTURES), RE2[name], det, typ, luhn=(name == 'credit-card'))})")
    u = " UNION ALL ".join(parts)
    return f"""
WITH u AS ({u})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY fk, ord) - 1 AS INT) AS ord,
       "start", "end", text, detection, detection_type, score FROM u"""


def luhn_filter_q(spark, sf_dir):
    """Luhn validity of card-like numbers (digits of the derived card texts)."""
    from sievekit.functions.luhn import is_luhn_valid, luhn_checksum
    from sievekit.sources.tables import pii_fixture

    cards = pii_fixture(spark, sf_dir, ["card"]).select("doc_id", F.regexp_replace("text", "[^0-9]", "").alias("digits"))
    return cards.select("doc_id", "digits", luhn_checksum(F.col("digits")).alias("checksum"), is_luhn_valid(F.col("digits")).alias("luhn_valid"))


def luhn_filter_sql() -> str:
    from sievekit.sources.tables import pii_fixture_sql

    return f"""
WITH c AS (SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM ({pii_fixture_sql(['card'])}))
SELECT doc_id, digits, CAST({luhn_sql('digits')} AS INT) AS checksum, ({luhn_sql('digits')}) = 0 AS luhn_valid FROM c"""


# --- S1, S5, S7, D2 ------------------------------------------------------------


def contents_source_q(spark, sf_dir):
    """JSON requests of 1 to 50 texts as positioned content rows; a rejected request is one row with its message."""
    requests = RB.checked(RQ.batched_requests(spark, sf_dir))
    rows = requests.select("request_id", "code", "message", F.posexplode_outer("contents").alias("position", "text"))
    return rows.select("request_id", F.col("position").cast("int").alias("position"), F.length("text").alias("n_chars"), F.col("code").cast("int").alias("code"), "message")


_REQUEST, _POSITION = RQ.request_of("duckdb")
_REQUESTS_SQL = f"""d AS (SELECT doc_id, {_REQUEST} AS request_id, {_POSITION} AS position, text FROM documents),
q AS (SELECT request_id, max(position) >= 1 AND request_id % 11 = 3 AS rejected FROM d GROUP BY request_id)"""

CONTENTS_SOURCE_SQL = f"""WITH {_REQUESTS_SQL}
SELECT request_id, CAST(position AS INT) AS position, CAST(length(text) AS INT) AS n_chars, NULL::INT AS code, NULL::VARCHAR AS message
FROM d JOIN q USING (request_id) WHERE NOT rejected
UNION ALL SELECT request_id, NULL, NULL, 422, 'Parameters with invalid type: [1]' FROM q WHERE rejected"""

FANOUT_PARAMS = {"regex": ["email", "us-phone-number", "ipv4"], "custom": ["over_100_characters"]}


def multi_detector_fanout_q(spark, sf_dir):
    """Several kinds and functions in one projection; flat output."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    return detect(df, FANOUT_PARAMS, output="flat", on_error="failfast").select(*FLAT)


def _fanout_union_sql() -> str:
    parts = []
    for k, name in enumerate(FANOUT_PARAMS["regex"]):
        det, typ = NAMES[name]
        parts.append(f"SELECT {k} AS fk, * FROM ({spans_sql('SELECT doc_id, text FROM documents', RE2[name], det, typ)})")
    parts.append(
        "SELECT 3 AS fk, doc_id, 0 AS ord, 0 AS \"start\", CAST(length(text) AS INT) AS \"end\", text, 'over_100_characters' AS detection,"
        " 'over_100_characters' AS detection_type, CAST(1.0 AS DOUBLE) AS score FROM documents WHERE length(text) > 100"
    )
    return " UNION ALL ".join(parts)


def multi_detector_fanout_sql() -> str:
    return f"""
WITH u AS ({_fanout_union_sql()})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY fk, ord) - 1 AS INT) AS ord,
       "start", "end", text, detection, detection_type, score FROM u"""


def detections_table_q(spark, sf_dir):
    """The flat detections of the PII scan with the document's language, written by type in one job and read back."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    flat = detect(docs, {"regex": MULTI}, output="flat", on_error="failfast").select("doc_id", "lang", *FLAT[1:])
    path = scratch_path(spark, f"detections/{uuid.uuid4().hex}")
    RB.write_detections(flat, path)
    return spark.read.schema(flat.schema).parquet(path).where(F.col("detection_type") == "pii").select("doc_id", "lang", *FLAT[1:])


def detections_table_sql() -> str:
    parts = []
    for k, name in enumerate(MULTI):
        det, typ = NAMES[name]
        parts.append(f"SELECT {k} AS fk, * FROM ({spans_sql('SELECT doc_id, text FROM documents', RE2[name], det, typ, luhn=(name == 'credit-card'))})")
    return f"""
WITH u AS ({' UNION ALL '.join(parts)})
SELECT u.doc_id, d.lang, CAST(row_number() OVER (PARTITION BY u.doc_id ORDER BY fk, ord) - 1 AS INT) AS ord,
       "start", "end", u.text, detection, detection_type, score
FROM u JOIN documents d ON d.doc_id = u.doc_id"""


def response_assembly_q(spark, sf_dir):
    """One answer per request: a list of detections for each of its texts, in order, empty where nothing fired."""
    found = RB.answers(RB.checked(RQ.batched_requests(spark, sf_dir)), FANOUT_PARAMS, on_error="failfast")
    spans = lambda one: F.array_join(F.transform(one, lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["detection"])), ";")
    return found.select("request_id", F.size("response").alias("n_contents"), F.array_join(F.transform("response", spans), "|").alias("response"))


def response_assembly_sql() -> str:
    return f"""
WITH u AS ({_fanout_union_sql()}),
a AS (SELECT doc_id, string_agg(CAST("start" AS VARCHAR) || ':' || CAST("end" AS VARCHAR) || ':' || detection, ';' ORDER BY fk, ord) AS spans
      FROM u GROUP BY doc_id),
{_REQUESTS_SQL}
SELECT request_id, CAST(count(*) AS INT) AS n_contents, string_agg(coalesce(a.spans, ''), '|' ORDER BY position) AS response
FROM d JOIN q USING (request_id) LEFT JOIN a ON a.doc_id = d.doc_id WHERE NOT rejected GROUP BY request_id"""


def response_json_sink_q(spark, sf_dir):
    """Nested responses written as JSON lines, one per content, and read back from there."""
    df = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = detect(df, {"regex": SINK_NAMES}, on_error="failfast")
    out = scratch_path(spark, f"responses/{uuid.uuid4().hex}")
    response_json_sink(d, ["doc_id"], out)
    back = spark.read.schema("doc_id long, response array<struct<start:int,end:int,detection:string>>").json(out)
    spans = F.transform("response", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"), x["detection"]))
    return back.select("doc_id", F.size("response").alias("n_detections"), F.array_join(spans, ";").alias("spans"))


def response_json_sink(detected, key_cols: list[str], path: str) -> None:
    """Writes (keys, response) as JSON lines; ``response`` is the content's list of detections."""
    detected.select(*key_cols, F.col("detections").alias("response")).write.mode("overwrite").json(path)


def response_json_sink_sql() -> str:
    parts = []
    for k, name in enumerate(SINK_NAMES):
        det, typ = NAMES[name]
        parts.append(f"SELECT {k} AS fk, * FROM ({spans_sql('SELECT doc_id, text FROM documents', RE2[name], det, typ)})")
    return f"""
WITH u AS ({' UNION ALL '.join(parts)}),
a AS (SELECT doc_id, count(*) AS n, string_agg(CAST("start" AS VARCHAR) || ':' || CAST("end" AS VARCHAR) || ':' || detection, ';' ORDER BY fk, ord) AS spans
      FROM u GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(a.n, 0) AS INT) AS n_detections, coalesce(a.spans, '') AS spans
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id"""


SINK_NAMES = ["email", "us-phone-number"]


def build() -> dict:
    q: dict = {}
    q["email_by_lang"] = (email_by_lang, EMAIL_BY_LANG_SQL)
    for key, name in [
        ("email", "email"),
        ("credit_card", "credit-card"),
        ("ipv4", "ipv4"),
        ("ipv6", "ipv6"),
        ("us_ssn", "us-social-security-number"),
        ("us_phone", "us-phone-number"),
        ("uk_post_code", "uk-post-code"),
    ]:
        q[key] = (regex_query(name), regex_oracle(name))
    q["regex_spans"] = (regex_spans_q, spans_sql("SELECT doc_id, text FROM documents", CUSTOM_PATTERN, "custom-regex", "regex"))
    q["custom_regex"] = (custom_regex_q, spans_sql("SELECT doc_id, text FROM documents", CUSTOM_PATTERN, "custom-regex", "regex"))
    q["regex_multi"] = (regex_multi_q, regex_multi_sql())
    q["luhn_filter"] = (luhn_filter_q, luhn_filter_sql())
    q["contents_source"] = (contents_source_q, CONTENTS_SOURCE_SQL)
    q["multi_detector_fanout"] = (multi_detector_fanout_q, multi_detector_fanout_sql())
    q["detections_table"] = (detections_table_q, detections_table_sql())
    q["response_assembly"] = (response_assembly_q, response_assembly_sql())
    q["response_json_sink"] = (response_json_sink_q, response_json_sink_sql())
    return q
