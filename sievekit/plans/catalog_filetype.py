"""Registered queries for file-type validity scans.

JSON rows are derived from ``events.props`` in five shapes (valid, cut off,
unquoted keys, broken array, valid but wrong type), the same in both engines.
YAML runs over documents, XML over pages; those parsers have no SQL
counterpart, so their queries are checked by row count only.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from sievekit.operators import filetype as FT
from sievekit.plans.detect import detect
from sievekit.sources.tables import dealt_out, table

FLAT = ["event_id", "ord", "start", "end", "text", "detection", "detection_type", "score"]

JSON_FIXTURE_SQL = """CASE event_id % 5 WHEN 0 THEN props
  WHEN 1 THEN substr(props, 1, length(props) - 1)
  WHEN 2 THEN replace(props, '"', '')
  WHEN 3 THEN '[1,'
  ELSE '{"k": "x"}' END"""

# Fixed test schema (ours): an object with an integer k in [0, 90] and nothing else.
SCHEMA = {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 0, "maximum": 90}}, "additionalProperties": False}
SCHEMA_TEXT = json.dumps(SCHEMA)

# Fixed XSD for pages (ours): an html root with head and body elements.
PAGE_XSD = """<?xml version="1.0" encoding="UTF-8"?>
<xs:schema xmlns:xs="http://www.w3.org/2001/XMLSchema">
  <xs:element name="html">
    <xs:complexType>
      <xs:sequence>
        <xs:element name="head" type="xs:anyType"/>
        <xs:element name="body" type="xs:anyType"/>
      </xs:sequence>
      <xs:anyAttribute processContents="skip"/>
    </xs:complexType>
  </xs:element>
</xs:schema>"""


def json_rows(spark, sf_dir):
    return dealt_out(table(spark, sf_dir, "events")).select("event_id", F.expr(JSON_FIXTURE_SQL).alias("text"))


def _flat(df, params):
    return detect(df, params, output="flat", on_error="failfast").select(*FLAT)


def json_validity_q(spark, sf_dir):
    return _flat(json_rows(spark, sf_dir), {"file_type": ["json"]})


JSON_VALIDITY_SQL = f"""
WITH j AS (SELECT event_id, {JSON_FIXTURE_SQL} AS text FROM events)
SELECT event_id, 0 AS ord, 0 AS "start", CAST(length(text) AS INT) AS "end", text, 'invalid_json' AS detection,
       'file_type' AS detection_type, CAST(1.0 AS DOUBLE) AS score
FROM j WHERE NOT coalesce(json_valid(text), false)"""


def json_schema_conformance_q(spark, sf_dir):
    return _flat(json_rows(spark, sf_dir), {"file_type": [f"json-with-schema:{SCHEMA_TEXT}"]})


def _conforms_sql(t: str = "text") -> str:
    return (
        f"(json_type({t}) = 'OBJECT' AND json_type({t}, '$.k') IN ('UBIGINT', 'BIGINT')"
        f" AND TRY_CAST(json_extract({t}, '$.k') AS BIGINT) BETWEEN 0 AND 90 AND json_keys({t}) = ['k'])"
    )


JSON_SCHEMA_SQL = f"""
WITH j AS (SELECT event_id, {JSON_FIXTURE_SQL} AS text FROM events)
SELECT event_id, 0 AS ord, 0 AS "start", CAST(length(text) AS INT) AS "end", text,
       CASE WHEN NOT coalesce(json_valid(text), false) THEN 'invalid_json' ELSE 'json_schema_mismatch' END AS detection,
       'file_type' AS detection_type, CAST(1.0 AS DOUBLE) AS score
FROM j WHERE NOT coalesce(json_valid(text), false) OR NOT {_conforms_sql()}"""


def file_type_multi_q(spark, sf_dir):
    """several file types per request, in request order (json, then json-with-schema, then a bad schema)."""
    return _flat(json_rows(spark, sf_dir), {"file_type": ["json", f"json-with-schema:{SCHEMA_TEXT}", "json-with-schema:{bad"]})


FILE_TYPE_MULTI_SQL = f"""
WITH j AS (SELECT event_id, {JSON_FIXTURE_SQL} AS text, coalesce(json_valid({JSON_FIXTURE_SQL}), false) AS ok FROM events),
u AS (
  SELECT event_id, 0 AS fk, 0 AS "start", CAST(length(text) AS INT) AS "end", text, 'invalid_json' AS detection FROM j WHERE NOT ok
  UNION ALL
  SELECT event_id, 1, 0, CAST(length(text) AS INT), text, CASE WHEN NOT ok THEN 'invalid_json' ELSE 'json_schema_mismatch' END FROM j
  WHERE NOT ok OR NOT {_conforms_sql()}
  UNION ALL
  SELECT event_id, 2, 0, CAST(CASE WHEN ok THEN length('{{bad') ELSE length(text) END AS INT), text,
         CASE WHEN ok THEN 'invalid_schema' ELSE 'invalid_json' END FROM j)
SELECT event_id, CAST(row_number() OVER (PARTITION BY event_id ORDER BY fk) - 1 AS INT) AS ord, "start", "end", text, detection,
       'file_type' AS detection_type, CAST(1.0 AS DOUBLE) AS score FROM u"""


def yaml_validity_q(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), "text")
    return _flat(docs, {"file_type": ["yaml"]})


def yaml_schema_conformance_q(spark, sf_dir):
    rows = json_rows(spark, sf_dir)  # JSON is YAML; unquoted keys parse as YAML mappings
    return _flat(rows, {"file_type": [f"yaml-with-schema:{SCHEMA_TEXT}"]})


YAML_SCHEMA_SQL = f"""
WITH j AS (SELECT event_id, event_id % 5 AS shape, TRY_CAST(json_extract(props, '$.k') AS BIGINT) AS k, {JSON_FIXTURE_SQL} AS text FROM events)
SELECT event_id, 0 AS ord, 0 AS "start", CAST(length(text) AS INT) AS "end", text,
       CASE WHEN shape IN (1, 3) THEN 'invalid_yaml' ELSE 'yaml_schema_mismatch' END AS detection,
       'file_type' AS detection_type, CAST(1.0 AS DOUBLE) AS score
FROM j WHERE shape IN (1, 3, 4) OR k NOT BETWEEN 0 AND 90"""


def xml_validity_q(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("event_id"), F.col("html").alias("text"))
    return _flat(pages, {"file_type": ["xml"]})


def xml_schema_conformance_q(spark, sf_dir):
    """raw pages (mostly not well-formed) plus an XHTML rendering of every page URL
    that is well-formed and either conforms (even ids) or lacks a head (odd ids)."""
    pages = table(spark, sf_dir, "pages")
    raw = pages.select(F.col("page_id").alias("event_id"), F.col("html").alias("text"))
    url = F.replace(F.replace(F.replace(F.col("url"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    xhtml = pages.select(
        (-(F.col("page_id") + 1)).alias("event_id"),
        F.when(F.col("page_id") % 2 == 0, F.concat(F.lit('<html lang="x"><head/><body><a>'), url, F.lit("</a></body></html>")))
        .otherwise(F.concat(F.lit("<html><body>"), url, F.lit("</body></html>")))
        .alias("text"),
    )
    return _flat(raw.unionByName(xhtml), {"file_type": [f"xml-with-schema:{PAGE_XSD}"]})


def build() -> dict:
    return {
        "json_validity": (json_validity_q, JSON_VALIDITY_SQL),
        "json_schema_conformance": (json_schema_conformance_q, JSON_SCHEMA_SQL),
        "file_type_multi": (file_type_multi_q, FILE_TYPE_MULTI_SQL),
        "yaml_validity": (yaml_validity_q, None),
        "yaml_schema_conformance": (yaml_schema_conformance_q, YAML_SCHEMA_SQL),
        "xml_validity": (xml_validity_q, None),
        "xml_schema_conformance": (xml_schema_conformance_q, None),
    }
