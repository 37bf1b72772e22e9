"""Batches of contents in JSON requests (S1, S5) and the partitioned tables of results.

A request body holds ``contents``, a list of texts, and ``detector_params``. ``checked`` reads every
body once; ``contents_of`` makes one row per text with its position, so the texts of a large
request spread over tasks; ``answers`` puts the detections of each request together again in the
order of its texts. Only positions and detections are shuffled for that, never texts.

Tables are written by one job over one scan, a folder for each value of a column; a run
overwrites only the folders it has rows for. Rows of a value that holds most of them are dealt to
several writers by a hash of their key.

Edge cases: a body that is null, no JSON, or breaks a rule is rejected with code 422 and has no
contents; repeated keys count once, the last one; an empty text is a content, a null one makes
its request invalid; request ids must not repeat; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.plans.detect import detect
from sievekit.plans.quarantine import checked

WRITERS = 8

__all__ = ["answers", "checked", "contents_of", "write_detections", "write_partitioned", "write_requests"]


def contents_of(requests: DataFrame, key: str = "request_id") -> DataFrame:
    """(key, position, text) of every content of the valid requests."""
    return requests.where("valid").select(key, F.posexplode("contents").alias("position", "text"))


def answers(requests: DataFrame, params: dict, key: str = "request_id", **options) -> DataFrame:
    """(key, response) of the valid requests: a list of detections for each content, in order."""
    found = detect(contents_of(requests, key), params, **options).select(key, F.struct("position", "detections").alias("_one"))
    # By position alone: the metadata of a detection is a map, which has no order.
    by_position = F.array_sort(F.collect_list("_one"), lambda a, b: a["position"] - b["position"])
    ordered = F.transform(by_position, lambda one: one["detections"])
    return found.groupBy(key).agg(ordered.alias("response"))


def write_partitioned(rows: DataFrame, path: str, by: str, spread: str, writers: int = WRITERS) -> None:
    """Writes rows to a folder for each value of ``by``; a value's rows go to ``writers`` tasks, by a hash of ``spread``."""
    dealt = rows.withColumn("_writer", F.pmod(F.xxhash64(spread), F.lit(writers))).repartition(by, "_writer").drop("_writer")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_detections(flat: DataFrame, path: str, key: str = "doc_id", writers: int = WRITERS) -> None:
    """The flat detections, by type."""
    write_partitioned(flat, path, "detection_type", key, writers)


def write_requests(requests: DataFrame, path: str, key: str = "request_id", writers: int = WRITERS) -> None:
    """Checked requests, the valid ones apart from the rejected."""
    write_partitioned(requests, path, "valid", key, writers)
