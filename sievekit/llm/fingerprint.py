"""Document fingerprints by locally consistent parsing.

A text is a sequence of byte symbols. On each level, runs of one symbol become one
symbol, so neighbours differ; deterministic coin tossing then shrinks symbols to
labels 0 to 5 (a label is the lowest bit in which a symbol differs from the one
before it, and that bit's value; a few rounds reach six labels), and every local
maximum of the labels starts a phrase. A phrase is named by a hash of its symbols,
and the names are the next level's symbols, until one symbol is left. A cut depends
on a bounded neighbourhood only, so equal substrings get equal phrases inside,
wherever they stand, and an edit changes names only around it.

The fingerprint is a sketch of all phrase names of all levels: names are dealt to
``SLOTS`` slots by hash, and each slot keeps the name that comes first in an order
weighted by the bytes a phrase covers, so every level counts by the text it covers.
Likeness is the share of content in common: with J the share of equal slots among
those that either side fills, 2 J / (1 + J).

All texts of a slice are parsed together with numpy.

Edge cases: null text is empty; an empty text has an empty fingerprint, like only to
another empty one; equal texts have equal fingerprints; one text may be long (memory
follows the longest text and the slice size); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import mix64

SLOTS = 64
SHORT = 64
SLICE_BYTES = 1 << 18
BUCKETS_PER_PARTITION = 4
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_LAST = -(1 << 63)  # stands for a null id, after all others in descending order


def _tossed(alphabet: int) -> np.ndarray:
    """Coin tossing on two neighbouring labels below ``alphabet``, as a table [before, label]."""
    before, label = np.meshgrid(np.arange(alphabet), np.arange(alphabet), indexing="ij")
    differ = before ^ label
    low = np.bitwise_count((differ & -differ) - 1).astype(int)
    return np.where(differ > 0, 2 * low + ((label >> low) & 1), 0).astype(np.uint8).ravel()


_BYTES, _SEVEN, _FOUR, _THREE = _tossed(256), _tossed(128), _tossed(16), _tossed(8)
_BYTE_NAMES = mix64(np.arange(16 * 256, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D))


def _pairwise(table: np.ndarray, shift: int, label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round on small labels; the first symbol of a text counts as differing in the lowest bit."""
    pair = np.empty(len(label), np.uint16)
    pair[1:] = label[:-1]
    pair[:1] = 0
    pair <<= shift
    pair |= label
    out = table.take(pair)
    out[first] = label[first] & 1
    return out


def _phrase_starts(label: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where a phrase starts: first symbols, and local maxima inside a text."""
    start = np.zeros(len(label), bool)
    start[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    # The first symbol is a start; neither it nor the last one is compared across texts.
    last = first[1:] - 1
    start[last] = False
    start[first] = True
    return start


def _collapse(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of run starts, run lengths, first symbols of texts among the runs)."""
    new = np.empty(len(symbols), bool)
    new[:1] = True
    np.not_equal(symbols[1:], symbols[:-1], out=new[1:])
    new[first] = True
    at = np.flatnonzero(new)
    return at, np.diff(at, append=len(symbols)), np.searchsorted(at, first)


def parse(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Yields, level by level, (row, name, bytes covered) of all phrases of non-empty texts."""
    sizes = np.diff(offsets)
    rows = np.flatnonzero(sizes)
    if not len(rows):
        return
    first = offsets[:-1][rows]
    at, run, first = _collapse(data, first)
    symbol = data[at]
    # The bytes of short texts are yielded as a level of their own: such texts have few phrases.
    counts = np.diff(first, append=len(symbol))
    short = np.repeat(counts < SHORT, counts)
    yield np.repeat(rows, counts)[short], _BYTE_NAMES.take(symbol[short]), run[short]
    label = _pairwise(_BYTES, 8, symbol, first)
    label = _pairwise(_FOUR, 4, label, first)
    label = _pairwise(_THREE, 3, label, first)
    start = np.flatnonzero(_phrase_starts(label, first))
    rank = np.arange(len(symbol)) - np.repeat(start, np.diff(start, append=len(symbol)))
    value = _BYTE_NAMES.take(((rank & 15) << 8) | symbol)
    long_run = run > 1
    value[long_run] = mix64(value[long_run] + run[long_run].astype(np.uint64))
    name, covered = mix64(np.add.reduceat(value, start)), np.add.reduceat(run, start)
    first = np.searchsorted(start, first)
    while True:
        counts = np.diff(first, append=len(name))
        yield np.repeat(rows, counts), name, covered
        # A text of one phrase is done.
        going = counts > 1
        if not going.any():
            return
        kept = np.repeat(going, counts)
        rows, name, covered, counts = rows[going], name[kept], covered[kept], counts[going]
        first = np.cumsum(counts) - counts
        at, run, first = _collapse(name, first)
        covered = np.add.reduceat(covered, at)
        name = name[at]
        long_run = run > 1
        name[long_run] = mix64(name[long_run] + run[long_run].astype(np.uint64))
        differ = np.empty_like(name)
        differ[1:] = name[1:] ^ name[:-1]
        differ[first] = 1
        low = differ & (~differ + np.uint64(1))
        label = (np.bitwise_count(low - np.uint64(1)) << 1) | ((name & low) != 0).astype(np.uint8)
        label = _pairwise(_SEVEN, 7, label, first)
        label = _pairwise(_FOUR, 4, label, first)
        label = _pairwise(_THREE, 3, label, first)
        start = np.flatnonzero(_phrase_starts(label, first))
        rank = np.arange(len(name)) - np.repeat(start, np.diff(start, append=len(name)))
        value = mix64(name + rank.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        name, covered = mix64(np.add.reduceat(value, start)), np.add.reduceat(covered, start)
        first = np.searchsorted(start, first)


def sketch(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, SLOTS) of uint16; 0 is an empty slot."""
    n = len(offsets) - 1
    best = np.full(n * SLOTS, _NONE)
    for row, name, covered in parse(data, offsets):
        h = mix64(name ^ np.uint64(0x2545F4914F6CDD1D))
        unit = ((h >> np.uint64(12)).astype(np.float64) + 1) / float(1 << 52)
        order = (-np.log(unit) / covered).astype(np.float32).view(np.uint32).astype(np.uint64)
        np.minimum.at(best, row * SLOTS + (h % np.uint64(SLOTS)).astype(np.int64), (order << np.uint64(32)) | (name & np.uint64(0xFFFFFFFF)))
    kept = (mix64(best) % np.uint64(0xFFFF)).astype(np.uint16) + np.uint16(1)
    kept[best == _NONE] = 0
    return kept.reshape(n, SLOTS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, 0 to 1; two empty fingerprints are alike."""
    filled = ((a > 0) | (b > 0)).sum(1)
    equal = ((a == b) & (a > 0)).sum(1)
    j = np.where(filled > 0, equal / np.maximum(filled, 1), 1.0)
    return 2 * j / (1 + j)


def to_hex(sketches: np.ndarray) -> list[str]:
    return [row.tobytes().hex() for row in sketches.astype(">u2")]


def from_hex(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u2").astype(np.uint16)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)])


def sketch_texts(texts: list[bytes]) -> np.ndarray:
    """Sketches in slices of about SLICE_BYTES, so memory doesn't follow the batch."""
    out, start, total = [], 0, 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= SLICE_BYTES or i + 1 == len(texts):
            out.append(sketch(*_joined(texts[start : i + 1])))
            start, total = i + 1, 0
    return np.vstack(out) if out else np.zeros((0, SLOTS), np.uint16)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``fingerprint`` (hex) to every row; a column of that name is replaced."""

    @F.arrow_udf("string")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(to_hex(sketch_texts([(t or "").encode() for t in texts.to_pylist()])), pa.string())

    return docs.drop("fingerprint").withColumn("fingerprint", of(F.col(text)))


def bucket_bounds(ids: DataFrame, column: str, buckets: int) -> list[int]:
    """At most ``buckets`` ids that occur, ascending, the largest among them, about evenly spread."""
    shares = F.array(*[F.lit(k / buckets) for k in range(1, buckets)]) if buckets > 1 else F.array(F.lit(1.0))
    row = ids.agg(F.percentile_approx(column, shares, F.lit(10 * buckets + 1000)).alias("at"), F.max(column).alias("last")).first()
    return sorted({*row["at"], row["last"]}) if row["last"] is not None else []


def _bucket(value: Column, bounds: list[int]) -> tuple[Column, Column]:
    """(number of bounds below the value, whether it is a bound), by a coarse and a fine step."""
    wide = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + wide] for i in range(0, len(bounds), wide)]
    coarse = F.size(F.filter(F.array(*[F.lit(g[-1]) for g in groups]), lambda b: b < value))
    fine = F.element_at(F.array(*[F.array(*[F.lit(b) for b in g]) for g in groups]), F.least(coarse + 1, F.lit(len(groups))))
    return coarse * wide + F.size(F.filter(fine, lambda b: b < value)), F.exists(fine, lambda b: b == value)


def with_next(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows in descending doc_id inside buckets, sorted by (_bucket, _tail): doc_id, text, _bucket, _tail.

    A bucket ends with the row that follows it, marked as its tail: the first row of
    the next bucket, or of the first one after the last. So every row meets its
    successor inside one partition, after a single shuffle of the texts.
    """
    keyed = docs.select("doc_id", "text").withColumn("_at", F.coalesce("doc_id", F.lit(_LAST)))
    bounds = bucket_bounds(keyed.select("_at"), "_at", buckets)
    if not bounds:
        return keyed.select("doc_id", "text", F.lit(0).alias("_bucket"), F.lit(False).alias("_tail"))
    bucket, is_bound = _bucket(F.col("_at"), bounds)
    here = F.struct(F.col("_own").alias("_bucket"), F.lit(False).alias("_tail"))
    above = F.struct(((F.col("_own") + 1) % len(bounds)).alias("_bucket"), F.lit(True).alias("_tail"))
    placed = keyed.withColumn("_own", bucket).withColumn("_first", is_bound)
    sent = placed.withColumn("_to", F.explode(F.when(F.col("_first"), F.array(here, above)).otherwise(F.array(here))))
    flat = sent.select("doc_id", "text", "_at", "_to._bucket", "_to._tail")
    ordered = flat.repartition("_bucket").sortWithinPartitions("_bucket", "_tail", F.desc("_at"), "text")
    return ordered.select("doc_id", "text", "_bucket", "_tail")


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_edits(docs: DataFrame, buckets: int) -> DataFrame:
    """Fingerprints of every text and of its edited form, with their likeness and that to the next text."""
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
    ])

    def rows_of(ids: list, texts: list[str], tails: list[bool]) -> pa.RecordBatch:
        """Row i meets row i + 1; a tail row and the very last row only follow."""
        own = [i for i in range(len(ids) - 1) if not tails[i]]
        changed = [edited(texts[i], texts[i + 1]).encode() for i in own]
        plain = sketch_texts([t.encode() for t in texts])
        other = sketch_texts(changed)
        mine, following = plain[own], plain[[i + 1 for i in own]]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([ids[i] for i in own], pa.int64()), pa.array([len(texts[i]) for i in own], pa.int64()),
                pa.array([hashlib.sha256(c).hexdigest() for c in changed], pa.string()), pa.array(to_hex(mine), pa.string()),
                pa.array(to_hex(other), pa.string()), pa.array(likeness(mine, other)), pa.array(likeness(mine, following)),
            ],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, tails, held = [], [], [], 0
        for batch in batches:
            for doc_id, text, tail in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_tail")), strict=True):
                ids.append(doc_id)
                texts.append(text or "")
                tails.append(tail)
                held += len(texts[-1])
                if held >= 4 * SLICE_BYTES and len(ids) > 1:
                    yield rows_of(ids, texts, tails)
                    ids, texts, tails, held = ids[-1:], texts[-1:], tails[-1:], len(texts[-1])
        if len(ids) > 1:
            yield rows_of(ids, texts, tails)

    return with_next(docs, buckets).mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
