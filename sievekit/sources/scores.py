"""Deterministic score tables derived from the driver's tables.

There is no model in the test environment, so logits come from ``md5`` of the
scored unit, identically in Spark and DuckDB:
``logit = int(first 4 hex digits of md5(x)) / 65535 * 8 - 4``.
Whole texts are hashed (never prefixes).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievekit.operators.scores import RISK_NAMES, text_bytes
from sievekit.schema import posexploded
from sievekit.session import bound_batches
from sievekit.sources.tables import table

# Fixed label sets of the synthetic models (ours).
SEQ_LABELS = ["neutral", "toxic", "obscene", "threat", "insult"]
TOKEN_LABELS = ["O", "B-PER", "I-PER", "B-LOC", "I-LOC"]
VOCAB = ["Yes", "No", " yes", "no ", "YES", "maybe", "", "The", "I", "safe"]
STEPS = 3
CANDIDATES = 24


def md5_logit(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x), 1, 4), 16, 10).cast("double") / F.lit(65535.0) * F.lit(8.0) - F.lit(4.0)


def md5_logit_sql(x: str) -> str:
    return f"(CAST(('0x' || substr(md5({x}), 1, 4)) AS INT) / 65535.0 * 8.0 - 4.0)"


def _labels_array(labels: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in labels])


def sequence_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(content_id, label_idx, label, logit) for every document and label."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_id"), "text")
    ex = docs.select("content_id", "text", F.posexplode(_labels_array(SEQ_LABELS)).alias("label_idx", "label"))
    return ex.select("content_id", "label_idx", "label", md5_logit(F.concat(F.col("text"), F.lit("#"), F.col("label_idx").cast("string"))).alias("logit"))


def sequence_logits_sql() -> str:
    labels = ", ".join(f"'{x}'" for x in SEQ_LABELS)
    return f"""SELECT content_id, CAST(label_idx AS INT) AS label_idx, ([{labels}])[label_idx + 1] AS label,
       {md5_logit_sql("text || '#' || CAST(label_idx AS VARCHAR)")} AS logit
FROM (SELECT doc_id AS content_id, text, unnest(range({len(SEQ_LABELS)})) AS label_idx FROM documents)"""


def embedding_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-local logits from ``embeddings``: every dimension x 10 (array form)."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("content_id"), F.transform("embedding", lambda x: x.cast("double") * 10.0).alias("logits"))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _starts_from_lengths(lengths: pa.Array) -> pa.Array:
    """Start offset of each single-space-separated token: exclusive prefix sum of (length + 1)."""
    flat, rows = lengths.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lengths.offsets.to_numpy().astype(np.int64)
    rows = rows - rows[0]
    before = np.concatenate([[0], np.cumsum(flat + 1)])
    starts = before[:-1] - np.repeat(before[rows[:-1]], np.diff(rows))
    none = np.append(~lengths.is_valid().to_numpy(zero_copy_only=False), False)
    return pa.ListArray.from_arrays(pa.array(rows.astype(np.int32), mask=none), pa.array(starts.astype(np.int32)))


def _doc_tokens(spark: SparkSession, sf_dir: str, docs: DataFrame | None):
    bound_batches(spark)
    if docs is None:
        docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_id"), "text")
    keep = [c for c in docs.columns if c != "text"]
    toks = docs.select(*keep, F.split("text", " ", -1).alias("toks"))
    return keep, toks.withColumn("starts", _starts_from_lengths(F.transform("toks", lambda t: F.length(t))))


def tokens(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Whitespace tokens of every document with code-point offsets, one row per token.

    The offsets are a prefix sum within the document row (vectorised in an
    Arrow batch), so tokenising needs no shuffle; ``explode`` keeps every token
    in its document's partition.
    """
    keep, toks = _doc_tokens(spark, sf_dir, docs)
    ex = posexploded(toks, keep, F.arrays_zip(F.col("toks").alias("token"), F.col("starts").alias("char_start")), "z")
    return ex.select(*keep, F.col("ord").alias("token_idx"), F.col("z.token").alias("token"), F.col("z.char_start").alias("char_start"), (F.col("z.char_start") + F.length("z.token")).cast("int").alias("char_end"))


TOKENS_SQL = """SELECT content_id, token_idx, token,
       CAST(coalesce(sum(length(token) + 1) OVER (PARTITION BY content_id ORDER BY token_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS char_start,
       CAST(coalesce(sum(length(token) + 1) OVER (PARTITION BY content_id ORDER BY token_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(token) AS INT) AS char_end
FROM (SELECT doc_id AS content_id, CAST(unnest(range(len(string_split(text, ' ')))) AS INT) AS token_idx, unnest(string_split(text, ' ')) AS token FROM documents)"""


def token_logits(tok: DataFrame) -> DataFrame:
    ex = tok.select("*", F.posexplode(_labels_array(TOKEN_LABELS)).alias("label_idx", "label"))
    return ex.withColumn("logit", md5_logit(F.concat(F.col("token"), F.lit("#"), F.col("label_idx").cast("string"))))


def token_logits_array(token: Column) -> Column:
    """The logits of one token, one element per label."""
    return F.array(*[md5_logit(F.concat(token, F.lit(f"#{i}"))) for i in range(len(TOKEN_LABELS))])


# Hashes of many short units at once: MD5 of one block each, as arithmetic on whole columns of words.
MD5_AT_ONCE, MD5_BLOCK, MD5_ROOM = 1 << 15, 64, 55
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * 2**32)) for i in range(64)]
_STATE = [np.uint32(x) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]


def _md5_first_words(words: list) -> np.ndarray:
    """First 32 bits of the MD5 of messages of one padded block each; ``words`` has its 16 words, a
    column each, None where all are 0. What the last three rounds change is not in these bits."""
    a, b, c, d = (np.full(len(words[14]), x) for x in _STATE)
    f, r = np.empty_like(a), np.empty_like(a)
    for i in range(61):
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
            word = words[i]
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
            word = words[(5 * i + 1) % 16]
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            f ^= d
            word = words[(3 * i + 5) % 16]
        else:
            np.invert(d, out=f)
            f |= b
            f ^= c
            word = words[7 * i % 16]
        f += a
        f += _SINES[i]
        if word is not None:
            f += word
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=r)
        f <<= np.uint32(_TURNS[i])
        f |= r
        f += b
        a, b, c, d, f = d, f, b, c, a
    return b + _STATE[0]


def md5_logits(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_labels: int) -> np.ndarray:
    """``md5_logit`` of each unit ``data[start:end]`` (bytes) with ``#0``, ``#1``, ... behind it, a row for
    each unit. Units too long for a block are hashed one at a time."""
    lengths, digits = ends - starts, [str(i).encode() for i in range(n_labels)]
    out = np.empty((n_labels, len(starts)))
    short = lengths + 1 + len(digits[-1]) <= MD5_ROOM
    for i in np.flatnonzero(~short):
        unit = hashlib.md5(data[starts[i] : ends[i]].tobytes() + b"#", usedforsecurity=False)
        for k, digit in enumerate(digits):
            whole = unit.copy()
            whole.update(digit)
            out[k, i] = int(whole.hexdigest()[:4], 16)
    rows = np.flatnonzero(short)
    for at in range(0, len(rows), MD5_AT_ONCE):
        some = rows[at : at + MD5_AT_ONCE]
        start, n, every = starts[some], lengths[some], np.arange(len(some))
        block = np.zeros((MD5_BLOCK // 4, len(some)), "<u4")  # a word of all units is one row
        flat = block.view(np.uint8).reshape(-1)

        def put(places, which, byte, flat=flat, width=len(some)):
            flat[(places // 4 * width + which) * 4 + places % 4] = byte

        for j in range(int(n.max())):
            has = np.flatnonzero(n > j)
            put(j, has, data[start[has] + j])
        put(n, every, ord("#"))
        top = (int(n.max()) + 1 + len(digits[-1])) // 4
        words = [w if i <= top or i == 14 else None for i, w in enumerate(block)]
        before = b""
        for digit in digits:
            for j, byte in enumerate(digit + b"\x80"):
                if before[j : j + 1] != bytes([byte]):
                    put(n + 1 + j, every, byte)
            block[14], before = 8 * (n + 1 + len(digit)), digit + b"\x80"
            first = _md5_first_words(words)
            out[int(digit), some] = (first & 0xFF) << 8 | (first >> 8) & 0xFF
    return out.T / 65535.0 * 8.0 - 4.0


TOKEN_SCORES = T.StructType(
    [
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("logits", T.ArrayType(T.DoubleType())),
    ]
)


SLICE_BYTES = 1 << 19


def row_slices(texts: pa.Array) -> Iterator[pa.Array]:
    """Whole rows, about ``SLICE_BYTES`` of text at a time: scores take ten times the room of their text."""
    at, row = text_bytes(texts)[1], 0
    while row < len(texts):
        to = max(row + 1, int(np.searchsorted(at, at[row] + SLICE_BYTES, side="right")) - 1)
        yield texts.slice(row, to - row)
        row = to


@F.arrow_udf(TOKEN_SCORES)
def _token_scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield from map(scores_of_texts, row_slices(batch))


def scores_of_texts(texts: pa.Array) -> pa.Array:
    """What a tokenizer and a model give for whole texts: offsets of the tokens of each, and their logits in one array."""
    valid = texts.is_valid().to_numpy(zero_copy_only=False)
    data, at = text_bytes(texts)
    blanks = np.flatnonzero(data == ord(" "))
    counts = np.where(valid, np.diff(np.searchsorted(blanks, at)) + 1, 0)
    rows = np.concatenate([[0], np.cumsum(counts)])
    # A token starts where its text does or behind a blank, and ends at a blank or with its text.
    is_first, is_last = np.zeros(rows[-1], bool), np.zeros(rows[-1], bool)
    is_first[rows[:-1][valid]], is_last[rows[1:][valid] - 1] = True, True
    starts, ends = np.empty(rows[-1], np.int64), np.empty(rows[-1], np.int64)
    starts[is_first], starts[~is_first] = at[:-1][valid], blanks + 1
    ends[is_last], ends[~is_last] = at[1:][valid], blanks
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    before = np.repeat(points[at[:-1]], counts)
    logits = md5_logits(data, starts, ends, len(TOKEN_LABELS))

    def lists(offsets: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(~valid, False)), pa.array(values))

    parts = [lists(rows, (points[x] - before).astype(np.int32)) for x in (starts, ends)] + [lists(rows * len(TOKEN_LABELS), logits.ravel())]
    return pa.StructArray.from_arrays(parts, names=["starts", "ends", "logits"])


def token_scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``tokens`` and ``token_logits_array`` with one row per content: ``starts``, ``ends`` and ``logits`` (one element
    for each token and label) are arrays, beside the columns of ``docs``."""
    bound_batches(spark)
    return docs.withColumn("_s", _token_scores("text")).select(*docs.columns, "_s.starts", "_s.ends", "_s.logits")


def sequence_logits_array(text: Column) -> Column:
    return F.array(*[md5_logit(F.concat(text, F.lit(f"#{i}"))) for i in range(len(SEQ_LABELS))])


def token_logits_sql() -> str:
    labels = ", ".join(f"'{x}'" for x in TOKEN_LABELS)
    return f"""SELECT t.*, CAST(l.label_idx AS INT) AS label_idx, ([{labels}])[l.label_idx + 1] AS label,
       {md5_logit_sql("t.token || '#' || CAST(l.label_idx AS VARCHAR)")} AS logit
FROM ({TOKENS_SQL}) t, (SELECT unnest(range({len(TOKEN_LABELS)})) AS label_idx) l"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(content_id, risk, step) of every conversation turn."""
    conv = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("content_id"), "text")
    return conv.select(
        "content_id",
        F.explode(_labels_array(RISK_NAMES)).alias("risk"),
        F.explode(F.sequence(F.lit(0), F.lit(STEPS - 1))).alias("step"),
    )


def _candidate(cand: Column) -> tuple[Column, Column]:
    """(token, logprob) of one candidate of a step."""
    key = F.concat_ws("#", F.col("content_id").cast("string"), F.col("risk"), F.col("step").cast("string"), cand.cast("string"))
    h = F.conv(F.substring(F.md5(key), 1, 4), 16, 10).cast("int")
    token = F.element_at(_labels_array(VOCAB), (h % len(VOCAB) + 1).cast("int"))
    return token, F.lit(0.0) - F.conv(F.substring(F.md5(key), 5, 4), 16, 10).cast("double") / F.lit(65535.0) * F.lit(12.0)


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation candidates per (conversation turn, risk, step): token and logprob."""
    ex = _steps(spark, sf_dir).select("*", F.explode(F.sequence(F.lit(0), F.lit(CANDIDATES - 1))).alias("cand"))
    token, logprob = _candidate(F.col("cand"))
    return ex.select("content_id", "risk", F.col("step").cast("int").alias("step"), token.alias("token"), logprob.alias("logprob"))


def candidate_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``candidates``, one row per step with its candidates as an array of (logprob, token)."""

    def candidate(cand: Column) -> Column:
        token, logprob = _candidate(cand)
        return F.struct(logprob.alias("logprob"), token.alias("token"))

    every = F.transform(F.sequence(F.lit(0), F.lit(CANDIDATES - 1)), candidate)
    return _steps(spark, sf_dir).select("content_id", "risk", F.col("step").cast("int").alias("step"), every.alias("candidates"))


def candidates_sql() -> str:
    risks = ", ".join(f"'{x}'" for x in RISK_NAMES)
    vocab = ", ".join(f"'{x}'" for x in VOCAB)
    key = "CAST(content_id AS VARCHAR) || '#' || risk || '#' || CAST(step AS VARCHAR) || '#' || CAST(cand AS VARCHAR)"
    return f"""SELECT content_id, risk, CAST(step AS INT) AS step,
       ([{vocab}])[CAST(('0x' || substr(md5({key}), 1, 4)) AS INT) % {len(VOCAB)} + 1] AS token,
       0.0 - CAST(('0x' || substr(md5({key}), 5, 4)) AS INT) / 65535.0 * 12.0 AS logprob
FROM (SELECT conv_id * 1000 + turn AS content_id FROM conversations) c,
     (SELECT unnest([{risks}]) AS risk) r,
     (SELECT unnest(range({STEPS})) AS step) s,
     (SELECT unnest(range({CANDIDATES})) AS cand) k"""
