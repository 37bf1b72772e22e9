"""Structured Streaming forms.

The same Column plans as batch run on ``readStream`` input. Sinks are
fault tolerant: file sinks with a checkpoint for append-only detections, and
for running aggregates ``update`` mode into ``foreachBatch``, which writes each
micro-batch to its own ``batch_id=N`` folder with overwrite (a retried batch
rewrites the same folder, so replays are idempotent). The current state of an
aggregate is the latest row per key across batches. All state and sink folders
sit under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.plans.detect import detect
from sievekit.session import scratch_path


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A parquet table as a streaming source (schema taken from the files once)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parq[u]et"  # glob that matches exactly this file
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").schema
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def run_folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, f"streams/{name}/{uuid.uuid4().hex}")


def stream_detect(stream: DataFrame, params: dict, out_dir: str, text_col: str = "text", timeout_s: int | None = None) -> str:
    """Detections of a stream, appended to a parquet sink (row-local, so append mode)."""
    flat = detect(stream, params, text_col=text_col, output="flat", on_error="quarantine").drop("metadata")
    q = (
        flat.writeStream.format("parquet")
        .option("checkpointLocation", f"{out_dir}/_checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start(f"{out_dir}/data")
    )
    q.awaitTermination(timeout_s)
    _raise_if_failed(q)
    return f"{out_dir}/data"


def _batch_writer(out_dir: str):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out_dir}/data/batch_id={batch_id}")

    return write


def stream_aggregate(agg: DataFrame, out_dir: str, timeout_s: int | None = None) -> str:
    """Run a streaming aggregate in update mode into per-batch folders (idempotent replays)."""
    q = (
        agg.writeStream.outputMode("update")
        .option("checkpointLocation", f"{out_dir}/_checkpoint")
        .foreachBatch(_batch_writer(out_dir))
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination(timeout_s)
    _raise_if_failed(q)
    return f"{out_dir}/data"


def latest_state(spark: SparkSession, path: str, key_cols: list[str]) -> DataFrame:
    """Current value per key = the row of the highest batch that updated it."""
    changes = spark.read.parquet(path)
    values = [c for c in changes.columns if c not in (*key_cols, "batch_id")]
    last = changes.groupBy(*key_cols).agg(F.max_by(F.struct(*values), "batch_id").alias("last"))
    return last.select(*key_cols, "last.*")


def stream_counters(stream: DataFrame, params: dict, out_dir: str, text_col: str = "text", timeout_s: int | None = None) -> str:
    """Ever-growing requests/detections/errors per (kind, name)."""
    d = detect(stream, params, text_col=text_col, with_calls=True, on_error="quarantine")
    calls = d.select(F.explode("calls").alias("c")).select("c.*")
    agg = calls.groupBy("detector_kind", "detector_name").agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("hit") & F.col("error").isNull()).alias("detections"),
        F.count_if(F.col("error").isNotNull()).alias("errors"),
    )
    return stream_aggregate(agg, out_dir, timeout_s)


def stream_windowed_rate(stream: DataFrame, flag_col: str, ts_col: str, window: str, watermark: str, out_dir: str, timeout_s: int | None = None, slide: str | None = None) -> str:
    """Share of flagged rows per event-time window, late data bounded by a watermark.

    With ``slide``, windows of that length begin so often and overlap; a row counts in each that it falls into.
    """
    agg = (
        stream.withWatermark(ts_col, watermark)
        .groupBy(F.window(ts_col, window, slide).alias("w"))
        .agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col(flag_col)).alias("flagged"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "events", "flagged")
    )
    return stream_aggregate(agg, out_dir, timeout_s)


def stream_windowed_split(
    stream: DataFrame, flag_col: str, ts_col: str, window: str, watermark: str, out_dir: str, timeout_s: int | None = None, slide: str | None = None
) -> tuple[str, str]:
    """T3 with a sink of its own for what comes too late, so that on-time and late rows together are all rows.

    The watermark of a micro-batch is the greatest event time of all batches before it less
    ``watermark``. A row is late for a window that ends at or before it; with ``slide`` it may be late
    for some of its windows only. The first sink holds each batch's counts of its windows, added up by
    ``window_totals``; no state is kept between batches but one time stamp. The second holds the late
    rows whole, once for each window missed (``window_start``, ``window_end``). Rows without an event
    time are late with null windows.

    Every sink has a folder for each batch, written with overwrite, and a batch reads only the
    watermark of the one before, so a batch that runs again after a failure writes the same rows.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        mark = spark.read.parquet(f"{out_dir}/seen/batch_id={batch_id - 1}").first() if batch_id else None
        before = mark["seen"] if mark else None
        latest = F.lit(before).cast("timestamp") - F.expr(f"INTERVAL {watermark}")
        batch.persist()
        try:
            rows = batch.select("*", F.window(ts_col, window, slide).alias("_w"))
            rows = rows.select("*", F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end")).drop("_w")
            behind = F.coalesce(F.col("window_end") <= latest, F.lit(False))
            on_time = rows.where(~behind).groupBy("window_start", "window_end").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col(flag_col)).alias("flagged"))
            on_time.write.mode("overwrite").parquet(f"{out_dir}/on_time/batch_id={batch_id}")
            late = batch.where(F.col(ts_col).isNull()).unionByName(rows.where(behind), allowMissingColumns=True)
            late.write.mode("overwrite").parquet(f"{out_dir}/late/batch_id={batch_id}")
            seen = batch.agg(F.greatest(F.max(ts_col), F.lit(before).cast("timestamp")).alias("seen"))
            seen.write.mode("overwrite").parquet(f"{out_dir}/seen/batch_id={batch_id}")
        finally:
            batch.unpersist()

    q = stream.writeStream.option("checkpointLocation", f"{out_dir}/_checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination(timeout_s)
    _raise_if_failed(q)
    return f"{out_dir}/on_time", f"{out_dir}/late"


def window_totals(spark: SparkSession, on_time: str) -> DataFrame:
    """(window_start, window_end, events, flagged) over all batches of ``stream_windowed_split``."""
    counts = spark.read.parquet(on_time)
    return counts.groupBy("window_start", "window_end").agg(F.sum("events").alias("events"), F.sum("flagged").alias("flagged"))


def stream_side_output(stream: DataFrame, main_params: dict, side_fn, out_dir: str, key_cols: list[str], timeout_s: int | None = None) -> tuple[str, str]:
    """T4: one pass per micro-batch, two sinks: main detections and a background detector's findings."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            detect(batch, main_params, output="flat", on_error="quarantine").drop("metadata").write.mode("overwrite").parquet(f"{out_dir}/main/batch_id={batch_id}")
            side_fn(batch).write.mode("overwrite").parquet(f"{out_dir}/side/batch_id={batch_id}")
        finally:
            batch.unpersist()

    q = stream.writeStream.option("checkpointLocation", f"{out_dir}/_checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination(timeout_s)
    _raise_if_failed(q)
    return f"{out_dir}/main", f"{out_dir}/side"


def _raise_if_failed(q) -> None:
    if q.isActive:
        q.stop()
        raise TimeoutError(f"streaming query {q.id} did not finish")
    err = q.exception()
    if err is not None:
        raise RuntimeError(str(err))
