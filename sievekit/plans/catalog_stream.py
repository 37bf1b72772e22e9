"""Registered queries for the streaming forms (T1-T4): each runs a Structured
Streaming query to completion (``availableNow``) over a table source and
returns the sink's contents."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievekit.operators import custom as C
from sievekit.operators.filetype import json_ok
from sievekit.plans.catalog_filetype import JSON_FIXTURE_SQL
from sievekit.plans.catalog_regex import RE2, spans_sql
from sievekit.sources.tables import table
from sievekit.streaming import stream as ST

FLAT = ["doc_id", "ord", "start", "end", "text", "detection", "detection_type", "score"]
T_PARAMS = {"regex": ["email", "us-phone-number"]}
ARRIVALS = 4
C_PARAMS = {"regex": ["email", "us-phone-number", "ipv4"], "custom": ["over_100_characters"]}


def stream_detect_q(spark, sf_dir):
    docs = ST.table_stream(spark, sf_dir, "documents").select("doc_id", "text")
    out = ST.stream_detect(docs, T_PARAMS, ST.run_folder(spark, "detect"))
    return spark.read.parquet(out).select(*FLAT)


def stream_detect_sql() -> str:
    parts = []
    for k, name in enumerate(T_PARAMS["regex"]):
        det = {"email": "email_address", "us-phone-number": "us-phone-number"}[name]
        parts.append(f"SELECT {k} AS fk, * FROM ({spans_sql('SELECT doc_id, text FROM documents', RE2[name], det, 'pii')})")
    return f"""
WITH u AS ({' UNION ALL '.join(parts)})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY fk, ord) - 1 AS INT) AS ord, "start", "end", text, detection, detection_type, score FROM u"""


def stream_counters_q(spark, sf_dir):
    docs = ST.table_stream(spark, sf_dir, "documents", max_files_per_trigger=1).select("doc_id", "text")
    out = ST.stream_counters(docs, C_PARAMS, ST.run_folder(spark, "counters"))
    return ST.latest_state(spark, out, ["detector_kind", "detector_name"]).select("detector_kind", "detector_name", "requests", "detections", "errors")


STREAM_COUNTERS_SQL = f"""
SELECT 'regex' AS detector_kind, 'email' AS detector_name, count(*) AS requests, count(*) FILTER (WHERE len(regexp_extract_all(text, '{RE2['email']}')) > 0) AS detections, CAST(0 AS BIGINT) AS errors FROM documents
UNION ALL SELECT 'regex', 'us-phone-number', count(*), count(*) FILTER (WHERE len(regexp_extract_all(text, '{RE2['us-phone-number']}')) > 0), 0 FROM documents
UNION ALL SELECT 'regex', 'ipv4', count(*), count(*) FILTER (WHERE len(regexp_extract_all(text, '{RE2['ipv4']}')) > 0), 0 FROM documents
UNION ALL SELECT 'custom', 'over_100_characters', count(*), count(*) FILTER (WHERE length(text) > 100), 0 FROM documents"""


def stream_windowed_rate_q(spark, sf_dir):
    # events.ts is a wall-clock TIMESTAMP_NTZ; watermarks need an instant: read it as UTC
    # (unix_timestamp of an NTZ value applies no zone), whole seconds suffice for day windows.
    ev = ST.table_stream(spark, sf_dir, "events").select(
        "event_id", F.timestamp_seconds(F.unix_timestamp("ts")).alias("event_time"), F.expr(JSON_FIXTURE_SQL).alias("text")
    )
    flagged = ev.withColumn("invalid_json", ~json_ok(F.col("text")))
    out = ST.stream_windowed_rate(flagged, "invalid_json", "event_time", "1 day", "1 hour", ST.run_folder(spark, "rate"), slide="8 hours")
    st = ST.latest_state(spark, out, ["window_start"])
    return st.select(
        F.unix_timestamp("window_start").alias("window_start_epoch"),
        "events",
        "flagged",
        F.round(F.col("flagged") / F.col("events"), 6).alias("rate"),
    )


# Each event counts in the three windows of a day that begin every eight hours.
STREAM_WINDOWED_RATE_SQL = f"""
WITH e AS (SELECT CAST(floor(epoch(ts)) AS BIGINT) AS sec, {JSON_FIXTURE_SQL} AS text FROM events),
w AS (SELECT sec - sec % 28800 - k * 28800 AS window_start_epoch, text FROM e, (SELECT unnest([0, 1, 2]) AS k))
SELECT window_start_epoch, count(*) AS events,
       count(*) FILTER (WHERE NOT coalesce(json_valid(text), false)) AS flagged,
       round(count(*) FILTER (WHERE NOT coalesce(json_valid(text), false)) / count(*), 6) AS rate
FROM w GROUP BY 1"""


def stream_late_rows_q(spark, sf_dir):
    """T3 with late rows: events dealt to files without regard to their time, which arrive in four parts; both sinks by window."""
    ev = table(spark, sf_dir, "events").select(
        "event_id", F.timestamp_seconds(F.unix_timestamp("ts")).alias("event_time"), F.expr(JSON_FIXTURE_SQL).alias("text")
    )
    files = ST.run_folder(spark, "shuffled_events")
    ev.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id").write.parquet(files)
    each = -(-len(spark.read.schema(ev.schema).parquet(files).inputFiles()) // ARRIVALS)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", max(each, 1)).parquet(files)
    flagged = stream.withColumn("invalid_json", ~json_ok(F.col("text")))
    on_time, late = ST.stream_windowed_split(flagged, "invalid_json", "event_time", "1 day", "1 hour", ST.run_folder(spark, "split"), slide="8 hours")
    missed = spark.read.parquet(late).groupBy("window_start").agg(F.count(F.lit(1)).alias("events"), F.count_if("invalid_json").alias("flagged"))
    both = ST.window_totals(spark, on_time).drop("window_end").unionByName(missed)
    return both.groupBy(F.unix_timestamp("window_start").alias("window_start_epoch")).agg(F.sum("events").alias("events"), F.sum("flagged").alias("flagged"))


# Which rows are late depends on the order of files; both sinks together hold every row once for each window.
STREAM_LATE_ROWS_SQL = f"SELECT window_start_epoch, events, flagged FROM ({STREAM_WINDOWED_RATE_SQL})"


def stream_side_output_q(spark, sf_dir):
    docs = ST.table_stream(spark, sf_dir, "documents").select("doc_id", "text")
    reg = C.example_registry()
    reg.register("background_multiline", lambda t: t.contains("\n"), non_blocking=False)

    def side(batch):
        return C.side_output(batch, reg, ["background_multiline"], ["doc_id"]).select("doc_id", "detector_name", F.col("detection.detection").alias("detection"))

    main, found = ST.stream_side_output(docs, {"regex": ["email"], "custom": ["over_100_characters"]}, side, ST.run_folder(spark, "side"), ["doc_id"])
    one = lambda path, sink: spark.read.parquet(path).select("doc_id", F.lit(sink).alias("sink"), "detection")
    return one(main, "main").unionByName(one(found, "side"))


STREAM_SIDE_SQL = f"""SELECT doc_id, 'side' AS sink, 'background_multiline' AS detection FROM documents WHERE contains(text, chr(10))
UNION ALL SELECT doc_id, 'main', 'email_address' FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{RE2['email']}')) FROM documents)
UNION ALL SELECT doc_id, 'main', 'over_100_characters' FROM documents WHERE length(text) > 100"""


def build() -> dict:
    return {
        "stream_detect": (stream_detect_q, stream_detect_sql()),
        "stream_counters": (stream_counters_q, STREAM_COUNTERS_SQL),
        "stream_windowed_rate": (stream_windowed_rate_q, STREAM_WINDOWED_RATE_SQL),
        "stream_late_rows": (stream_late_rows_q, STREAM_LATE_ROWS_SQL),
        "stream_side_output": (stream_side_output_q, STREAM_SIDE_SQL),
    }
