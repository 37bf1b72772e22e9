"""Helpers that several corpus operators share.

Texts inside Arrow batches are handled as one byte buffer with row offsets, so
that the operators work on whole columns with numpy and never loop over
characters in Python.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.session import bound_batches as bound_batches
from sievekit.session import ensure_checkpoint_dir

# Words are runs of anything but space, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, LOWER)


def word_count(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cut(df: DataFrame) -> DataFrame:
    """Writes a narrow frame to the shared checkpoint folder and cuts its lineage.

    Spark removes the files once the frame is no longer referenced, where
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """Marks a cut frame for broadcasting if its rows fit Spark's own threshold, which
    Spark can't tell by itself of a checkpoint. Beyond it, joins shuffle both sides."""
    jconf = df.sparkSession._jsparkSession.sessionState().conf()
    return F.broadcast(df) if df.count() * row_bytes <= jconf.autoBroadcastJoinThreshold() else df


def likely_in(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi", buckets: int = 1 << 20) -> DataFrame:
    """The rows of ``df`` whose key falls into a bucket of some key in ``ids``: all that join with it,
    and few others while it is small, so that a join after it need not shuffle wide rows for
    nothing. With ``left_anti`` the rest. At most ``buckets`` integers are broadcast, whatever the
    tables' sizes."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    wanted = F.broadcast(ids.select(bucket.alias("_bucket")).distinct())
    return df.join(wanted, bucket == F.col("_bucket"), how)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within it, Spark removes a query's shuffle files when the query ends. For operators that
    cut many frames one after the other, whose files would otherwise pile up."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without copying; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def sliced(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Splits a batch so that each part has about ``most_bytes`` of text; a longer row stays whole."""
    sizes = np.asarray(
        pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64
    )
    start, total = 0, 0
    for row, size in enumerate(sizes.tolist()):
        if total and total + size > most_bytes:
            yield batch.slice(start, row - start)
            start, total = row, 0
        total += size
    if start < batch.num_rows:
        yield batch.slice(start)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (the public splitmix64 one)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = np.uint64(0xD1342543DE82EF95)
_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, kept between calls."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base)
        out[0] = 1
        have = _powers[int(base)] = np.multiply.accumulate(out)
    return have[:n]


def word_spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of bytes that are ``inside``; a run ends where its row does."""
    head, tail = inside.copy(), inside.copy()
    head[1:] &= ~inside[:-1]
    tail[:-1] &= ~inside[1:]
    edge = offsets[(offsets > 0) & (offsets < len(inside))]
    head[edge], tail[edge - 1] = inside[edge], inside[edge - 1]
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def token_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the slices of a byte buffer: polynomials of their bytes, from prefix sums."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_LETTER.take(data) * _power(_BASE, len(data)), out=sums[1:])
    word = (sums[end] - sums[start]) * _power(_INVERSE, len(data))[start]
    return mix64(word ^ ((end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
