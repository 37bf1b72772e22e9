"""XML Schema conformance (F6) with Spark's native XML reader.

Well-formedness is checked first (the reference's ``invalid_xml``); then
``from_xml`` validates every row against the XSD (``rowValidationXSDPath``),
routing failures to the corrupt-record column. The XSD text is written once to
the shared checkpoint folder and shipped with ``addFile`` so every executor
reads the same file.
"""

from __future__ import annotations

import hashlib
import os
import xml.etree.ElementTree as ET

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from sievekit.operators.filetype import FILE_TYPE, INVALID_XML, INVALID_XML_SCHEMA, XML_SCHEMA_MISMATCH, xml_ok
from sievekit.schema import DETECTIONS, detection_struct, whole_text_detection
from sievekit.session import scratch_path

XS = "{http://www.w3.org/2001/XMLSchema}"


def _root_element(schema: str) -> str | None:
    """Name of the first top-level element of a well-formed XSD, else None (not a schema)."""
    try:
        root = ET.fromstring(schema)
    except Exception:  # noqa: BLE001
        return None
    if root.tag != XS + "schema":
        return None
    for child in root:
        if child.tag == XS + "element" and child.get("name"):
            return child.get("name")
    return None


_SHIPPED: dict[str, str] = {}


def ship_xsd(spark: SparkSession, schema: str) -> str:
    """Write the XSD once under the shared checkpoint folder, ``addFile`` it, return its file name.

    Spark's own text writer puts it on whatever storage the checkpoint folder
    is on (local in tests, a shared file system on a cluster); executors then
    fetch it through ``addFile`` and ``from_xml`` finds it by name.
    """
    digest = hashlib.sha256(schema.encode()).hexdigest()[:16]
    key = f"{spark.sparkContext.applicationId}/{digest}"
    if key in _SHIPPED:
        return _SHIPPED[key]
    folder = scratch_path(spark, f"xsd/{digest}")
    spark.createDataFrame([(schema,)], "value string").coalesce(1).write.mode("overwrite").text(folder)
    path = spark.read.text(folder).inputFiles()[0]
    spark.sparkContext.addFile(path)
    _SHIPPED[key] = os.path.basename(path)
    return _SHIPPED[key]


def xml_schema_detection(text: Column, schema: str) -> Column:
    spark = SparkSession.getActiveSession()
    ok = xml_ok(text)
    invalid = whole_text_detection(text, INVALID_XML, FILE_TYPE)
    root = _root_element(schema)
    if root is None:
        bad_schema = detection_struct(F.lit(0), F.lit(len(schema)), text, INVALID_XML_SCHEMA, FILE_TYPE, 1.0)
        return F.when(~ok, F.array(invalid)).when(ok, F.array(bad_schema)).otherwise(F.array().cast(DETECTIONS))
    xsd_name = ship_xsd(spark, schema)
    parsed = F.from_xml(
        F.when(ok, text),
        "_corrupt_record string",
        {"rowTag": root, "rowValidationXSDPath": xsd_name, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"},
    )
    mismatch = whole_text_detection(text, XML_SCHEMA_MISMATCH, FILE_TYPE)
    return (
        F.when(~ok, F.array(invalid))
        .when(ok & parsed["_corrupt_record"].isNotNull(), F.array(mismatch))
        .otherwise(F.array().cast(DETECTIONS))
    )
