"""Table sources: the driver's parquet tables and fixtures derived from them.

Derived fixtures are SQL expressions over integer keys, written once as
templates so Spark and the DuckDB oracle compute the very same texts
(``{S}`` is the string type name of each engine).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


# Tables of texts, on which detectors spend far more time than a scan does.
TEXTS = ("documents", "conversations")
WORTH_DEALING, ENOUGH_PER_CORE = 4 << 20, 32 << 20


def dealt_out(df: DataFrame) -> DataFrame:
    """A table whose files are too few to give every core a part of the scan, dealt to all cores.

    Spark can't split a row group, so one file of 15 MB is one task for all detectors after it. A table
    of over ``ENOUGH_PER_CORE`` bytes for each core has parts enough and is left as it is, and so
    is one that is done before the dealing would be.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if WORTH_DEALING <= size < ENOUGH_PER_CORE * cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return dealt_out(df) if name in TEXTS else df


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as content rows (content_id, text) plus their attributes."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"))


# --- derived PII texts from customer keys ----------------------------------
# Each kind is one row per customer; ids are negative so they never meet doc ids.

_SEP2 = "CASE WHEN c_custkey % 2 = 0 THEN '-' ELSE ' ' END"
_SEP3 = "CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN '-' ELSE ' ' END"


def _hex4(m: int, engine: str) -> str:
    if engine == "spark":
        return f"lpad(lower(hex((c_custkey*{m}) % 65536)),4,'0')"
    return f"printf('%04x', (c_custkey*{m}) % 65536)"


FIXTURE_KINDS = ["ssn", "postcode", "card", "ipv6"]


def fixture_text_sql(kind: str, engine: str) -> str:
    S = "STRING" if engine == "spark" else "VARCHAR"
    if kind == "ssn":
        return (
            f"'SSN: ' || CAST(c_custkey % 900 + 100 AS {S}) || {_SEP2} || CAST(c_custkey % 90 + 10 AS {S})"
            f" || {_SEP2} || CAST(c_custkey % 9000 + 1000 AS {S}) || ' end'"
        )
    if kind == "postcode":
        return (
            "'Postcode: ' || chr(CAST(65 + c_custkey % 26 AS INT)) || chr(CAST(65 + (c_custkey*7) % 26 AS INT))"
            f" || CAST(c_custkey % 10 AS {S}) || CASE WHEN c_custkey % 3 = 0 THEN '' ELSE ' ' END"
            f" || CAST((c_custkey*3) % 10 AS {S})"
            " || chr(CAST(65 + (c_custkey*5) % 26 AS INT)) || chr(CAST(65 + (c_custkey*11) % 26 AS INT))"
        )
    if kind == "card":
        return (
            f"'Card: 4' || lpad(CAST((c_custkey*7919) % 1000 AS {S}),3,'0')"
            f" || {_SEP3} || lpad(CAST((c_custkey*104729) % 10000 AS {S}),4,'0')"
            f" || {_SEP3} || lpad(CAST((c_custkey*31) % 10000 AS {S}),4,'0')"
            f" || {_SEP3} || lpad(CAST((c_custkey*17) % 10000 AS {S}),4,'0')"
        )
    if kind == "ipv6":
        groups = " || ':' || ".join(_hex4(m, engine) for m in (7919, 104729, 31, 17, 3, 257, 65537, 11))
        return f"'addr ' || {groups} || ' end'"
    raise ValueError(kind)


def fixture_id_sql(kind: str) -> str:
    k = FIXTURE_KINDS.index(kind)
    return f"-(c_custkey * {len(FIXTURE_KINDS)} + {k + 1})"


def pii_fixture(spark: SparkSession, sf_dir: str, kinds: list[str]) -> DataFrame:
    cust = table(spark, sf_dir, "customer").select("c_custkey")
    parts = [cust.select(F.expr(fixture_id_sql(k)).cast("bigint").alias("doc_id"), F.expr(fixture_text_sql(k, "spark")).alias("text")) for k in kinds]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def pii_fixture_sql(kinds: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT CAST({fixture_id_sql(k)} AS BIGINT) AS doc_id, {fixture_text_sql(k, 'duckdb')} AS text FROM customer" for k in kinds)


def scan_input(spark: SparkSession, sf_dir: str, kinds: list[str]) -> DataFrame:
    """documents (doc_id, text) plus derived rows of the given fixture kinds."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    if not kinds:
        return docs
    return docs.unionByName(pii_fixture(spark, sf_dir, kinds))


def scan_input_sql(kinds: list[str]) -> str:
    base = "SELECT doc_id, text FROM documents"
    if not kinds:
        return base
    return base + " UNION ALL " + pii_fixture_sql(kinds)
