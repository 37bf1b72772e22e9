"""Classifier post-processing on score tables.

Inputs are long-form score tables, the contract a batch scorer emits:

* sequence: ``(content_id, label_idx, label, logit)``
* token:    ``(content_id, token_idx, char_start, char_end, label_idx, label, logit)``
* candidates: ``(content_id, risk, step, token, logprob)``, or an array of (logprob, token) per step

Scores of one unit may also come as an array, one element per label. Softmax and
the best label then stay inside the row, and the token chain shuffles only tokens
that have a label: once by (content, range of tokens) to fold runs, and the runs at
the edges of ranges once more to stitch them.

All tokens of one content may come in its row, too: ``starts``, ``ends`` and ``logits`` (one element
for each token and label). The whole token chain then stays in the row, in time linear in its text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values from the reference: the seven risks of the guardian model and
# its answer words; top-k of 20 candidates per generation step.
RISK_NAMES = ["harm", "social_bias", "jailbreak", "profanity", "unethical_behavior", "sexual_content", "violence"]
SAFE_TOKEN = "No"
UNSAFE_TOKEN = "Yes"
TOPK = 20
PRIOR = 1e-50
DEFAULT_THRESHOLD = 0.5
DEFAULT_MAX_LENGTH = 512
UNBOUNDED_MODEL_MAX = 1_000_000


@dataclass(frozen=True)
class Params:
    """Resolved, plan-time parameters (the reference's env defaults become arguments)."""

    threshold: float = DEFAULT_THRESHOLD
    label_thresholds: dict = field(default_factory=dict)
    safe_labels: tuple = (0,)
    max_length: int = DEFAULT_MAX_LENGTH


# --- M2 softmax ------------------------------------------------------------------


def softmax_long(df: DataFrame, group_cols: list[str], logit_col: str = "logit", out_col: str = "prob") -> DataFrame:
    """Softmax of ``logit`` within each group (max-shifted for stability)."""
    w = Window.partitionBy(*group_cols)
    shifted = F.exp(F.col(logit_col) - F.max(logit_col).over(w))
    return df.withColumn("_e", shifted).withColumn(out_col, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once. Spark evaluates what a lambda captures again for
    every element, so whatever is used inside one is bound to a lambda's variable first."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax_array(logits: Column) -> Column:
    """Softmax of an array column, row-local (no shuffle)."""

    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0).cast("double"), lambda a, x: a + x)
        return bound(total, lambda s: F.transform(powers, lambda x: x / s))

    def powers(values: Column) -> Column:
        return bound(F.array_max(values), lambda m: F.transform(values, lambda x: F.exp(x - m)))

    return bound(logits, lambda values: bound(powers(values), shares))


# --- thresholds and safe labels ------------------------------------------------------


def effective_threshold(label: Column, threshold: Column | float, label_thresholds: Column | dict) -> Column:
    thr = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    if isinstance(label_thresholds, dict):
        if not label_thresholds:
            return thr
        lt = F.create_map(*[x for k, v in label_thresholds.items() for x in (F.lit(k), F.lit(float(v)))])
    else:
        lt = label_thresholds
    return F.coalesce(F.element_at(lt, label), thr)


def safe_label_keys(labels) -> list[str]:
    """Safe labels as JSON-typed keys: int 0 -> '0', str 'O' -> '"O"' (0 and "0" differ)."""
    import json

    return [json.dumps(x) for x in labels if isinstance(x, (int, str)) and not isinstance(x, bool)]


def is_safe(label_idx: Column, label: Column, safe_keys: Column | list) -> Column:
    keys = safe_keys if isinstance(safe_keys, Column) else F.array(*[F.lit(k) for k in safe_keys]) if safe_keys else F.array().cast("array<string>")
    return F.array_contains(keys, label_idx.cast("string")) | F.array_contains(keys, F.concat(F.lit('"'), label, F.lit('"')))


# --- M3 sequence classification ---------------------------------------------------------


def sequence_classification(probs: DataFrame, threshold, label_thresholds, safe_keys, problem_type: str | None = None) -> DataFrame:
    """Rows (content_id, label_idx, label, prob) -> one detection row per label over its threshold.

    Inclusive threshold; label threshold overrides the global one; neither the
    index nor the name may be a safe label. Name is the model's problem type,
    else ``detection``.
    """
    thr = effective_threshold(F.col("label"), threshold, label_thresholds)
    keep = (F.col("prob") >= thr) & ~is_safe(F.col("label_idx"), F.col("label"), safe_keys)
    return probs.where(keep).select(
        "content_id",
        "label_idx",
        F.lit(problem_type or "detection").alias("detection"),
        F.col("label").alias("detection_type"),
        F.col("prob").alias("score"),
    )


# --- M4 / M5 / M6 token classification ------------------------------------------------------


def token_best_label(token_probs: DataFrame, threshold, label_thresholds, safe_keys) -> DataFrame:
    """Per token: the highest-probability non-safe label over its threshold; first label wins ties.

    Tokens with offsets (0, 0) are special tokens and skipped.
    """
    thr = effective_threshold(F.col("label"), threshold, label_thresholds)
    cand = token_probs.where(
        ~((F.col("char_start") == 0) & (F.col("char_end") == 0))
        & (F.col("prob") >= thr)
        & ~is_safe(F.col("label_idx"), F.col("label"), safe_keys)
    )
    best = F.max(F.struct(F.col("prob"), (-F.col("label_idx")).alias("neg_idx"), F.col("label"), F.col("char_start"), F.col("char_end")))
    keys = ["content_id", "token_idx"] + [c for c in ("token",) if c in token_probs.columns]
    out = cand.groupBy(*keys).agg(best.alias("b"))
    return out.select(*keys, F.col("b.label").alias("label"), F.col("b.prob").alias("prob"), F.col("b.char_start").alias("char_start"), F.col("b.char_end").alias("char_end"))


def label_limits(labels: list[str], threshold, label_thresholds, safe_keys) -> Column:
    """Effective threshold of every label as one array; null where the label is safe.

    Made once for a content, so its tokens carry a few numbers and no parameters.
    """
    limits = [
        F.when(~is_safe(F.lit(i), F.lit(x), safe_keys), effective_threshold(F.lit(x), threshold, label_thresholds))
        for i, x in enumerate(labels)
    ]
    return F.array(*limits)


def best_labels(tokens: DataFrame, logits: Column, limits: Column, labels: list[str]) -> DataFrame:
    """M2 and M4 without a shuffle: the tokens that have a label over its limit, with ``label`` and
    ``prob`` of the likeliest one, the first on ties. ``logits`` and ``limits`` are arrays.

    Each step is a projection over scalars, which Spark compiles and computes once per row.

    ``tokens`` with all tokens of a content in its row (arrays ``starts`` and ``ends``, ``logits`` with one
    element for each token and label) get an array ``best`` of their labelled tokens instead; there,
    tokens with offsets (0, 0) are special tokens and skipped.
    """
    if "starts" in tokens.columns:
        every = [c for c in tokens.columns if c not in ("starts", "ends", "logits")]
        return tokens.select(*every, _best_in_row(labels)("starts", "ends", logits, limits).alias("best"))
    every, n = tokens.columns, range(len(labels))
    step = tokens.select(*every, logits.alias("_l"), limits.alias("_limits")).select("*", F.array_max("_l").alias("_m"))
    step = step.select(*every, "_limits", *[F.exp(F.col("_l")[i] - F.col("_m")).alias(f"_e{i}") for i in n])
    step = step.select("*", sum((F.col(f"_e{i}") for i in n), F.lit(0.0)).alias("_s"))
    share = [F.col(f"_e{i}") / F.col("_s") for i in n]
    step = step.select(*every, *[F.when(share[i] >= F.col("_limits")[i], share[i]).alias(f"_p{i}") for i in n])
    first = F.coalesce(*[F.when(F.col(f"_p{i}") == F.col("_best"), F.lit(labels[i])) for i in n])
    step = step.select("*", F.greatest(*[F.col(f"_p{i}") for i in n]).alias("_best"))
    # A filter on the best would be pushed below, and all of it computed twice; so would be what Spark
    # infers of an inner explode.
    kept = F.explode_outer(F.when(F.col("_best").isNotNull(), F.array(F.struct(first.alias("label"), F.col("_best").alias("prob")))))
    return step.select(*every, kept.alias("_b")).where(F.col("_b").isNotNull()).select(*every, "_b.label", "_b.prob")


def _list_of(**kinds: type) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(name, kind()) for name, kind in kinds.items()]))


BEST_TOKENS = _list_of(token_idx=T.IntegerType, char_start=T.IntegerType, char_end=T.IntegerType, label=T.StringType, prob=T.DoubleType)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of strings, and where each string starts in them (and the last ends); null as empty."""
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def _row_ends(lists: pa.Array) -> np.ndarray:
    """Where the elements of each list start in all of them (and the last ends); a null list has none."""
    return np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])


def _best_in_row(labels: list[str]):
    @F.arrow_udf(BEST_TOKENS)
    def best(starts: pa.Array, ends: pa.Array, logits: pa.Array, limits: pa.Array) -> pa.Array:
        rows, none = _row_ends(starts), ~starts.is_valid().to_numpy(zero_copy_only=False)
        start, end = starts.flatten().to_numpy(), ends.flatten().to_numpy()
        powers = np.ascontiguousarray(logits.flatten().to_numpy().reshape(-1, len(labels)).T)
        powers = np.exp(powers - powers.max(axis=0))
        share = powers / powers.sum(axis=0)
        least = limits.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, len(labels)).T  # NaN where a label is safe
        share = np.where(share >= np.repeat(least, np.diff(rows), axis=1), share, -1.0)
        first = share.argmax(axis=0)
        prob = share[first, np.arange(len(first))]
        kept = np.flatnonzero((prob >= 0) & ~((start == 0) & (end == 0)))
        idx = kept - np.repeat(rows[:-1], np.diff(rows))[kept]
        found = [pa.array(idx.astype(np.int32)), pa.array(start[kept]), pa.array(end[kept]), pa.array(labels).take(pa.array(first[kept])), pa.array(prob[kept])]
        offsets = pa.array(np.searchsorted(kept, rows).astype(np.int32), mask=np.append(none, False))
        return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(found, names=["token_idx", "char_start", "char_end", "label", "prob"]))

    return best


SPANS_IN_ROW = _list_of(first_token=T.IntegerType, start=T.IntegerType, end=T.IntegerType, text=T.StringType, label=T.StringType, score=T.DoubleType)


@F.arrow_udf(SPANS_IN_ROW)
def _spans_in_row(texts: pa.Array, best: pa.Array) -> pa.Array:
    """Runs of adjacent tokens of one label, in token order within each row, with the slices of its text."""
    rows, tokens = _row_ends(best), best.flatten()
    token, start, end, prob = (tokens.field(c).to_numpy() for c in ("token_idx", "char_start", "char_end", "prob"))
    code = tokens.field("label").dictionary_encode().indices.to_numpy()
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1] + 1) | (code[1:] != code[:-1])
    new[rows[:-1][np.diff(rows) > 0]] = True
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(token))[: len(first)] - 1
    total = np.add.reduceat(prob, first) if len(first) else prob
    runs = np.searchsorted(first, rows)
    # Code points of all texts, so that a slice is two look-ups and not a walk from the start of its text.
    data, at = text_bytes(texts)
    points = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    base = np.repeat(np.searchsorted(points, at[:-1]), np.diff(runs))
    beyond = np.repeat(np.searchsorted(points, at[1:]), np.diff(runs))
    cut = [points[np.clip(base + x, base, beyond)] for x in (start[first], end[last])]
    size = np.maximum(cut[1] - cut[0], 0)
    ends = np.concatenate([[0], np.cumsum(size)])
    cut_bytes = data[np.repeat(cut[0] - ends[:-1], size) + np.arange(ends[-1])]
    text = pa.StringArray.from_buffers(len(first), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(cut_bytes))
    found = [pa.array(token[first]), pa.array(start[first]), pa.array(end[last]), text, tokens.field("label").take(pa.array(first)), pa.array(total / (last - first + 1))]
    return pa.ListArray.from_arrays(pa.array(runs.astype(np.int32)), pa.StructArray.from_arrays(found, names=["first_token", "start", "end", "text", "label", "score"]))


# A run's state: what two neighbouring runs of one label need to become one.
RUN_CHUNK = 1024


def _run_state(first: str, last: str, start: str, end: str, total: str, n: str) -> list[Column]:
    return [
        F.min_by(start, first).alias("start"),
        F.max_by(end, last).alias("end"),
        F.min(first).alias("first_token"),
        F.max(last).alias("last_token"),
        F.sum(total).alias("total"),
        F.sum(n).alias("n"),
    ]


def token_runs(best: DataFrame, chunk: int = RUN_CHUNK) -> DataFrame:
    """Runs of adjacent tokens of one label: (content_id, label, first_token, last_token, start,
    end, total, n), folded inside chunks of tokens and stitched at their edges.

    A chunk is a range of ``chunk`` tokens of one content, so a long content is spread over tasks.
    Only runs that touch an edge of their chunk meet again, by content and label; a run over
    whole chunks is one of them for each chunk. All others are finished in the first pass.
    """
    inside = Window.partitionBy("content_id", "chunk", "label").orderBy("token_idx")
    tokens = best.withColumn("chunk", F.floor(F.col("token_idx") / chunk)).withColumn("n", F.lit(1))
    tokens = tokens.withColumn("grp", F.col("token_idx") - F.row_number().over(inside))
    runs = tokens.groupBy("content_id", "chunk", "label", "grp").agg(*_run_state("token_idx", "token_idx", "char_start", "char_end", "prob", "n")).drop("chunk", "grp")
    at_edge = (F.col("first_token") % chunk == 0) | (F.col("last_token") % chunk == chunk - 1)
    # Both branches read the one shuffle of tokens.
    # Runs begin alike where a content's tokens come twice; the shorter one is stitched then.
    along = Window.partitionBy("content_id", "label").orderBy("first_token", "last_token")
    edge = runs.where(at_edge).withColumn("new", F.coalesce((F.lag("last_token").over(along) + 1 != F.col("first_token")).cast("int"), F.lit(1)))
    edge = edge.withColumn("grp", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    stitched = edge.groupBy("content_id", "label", "grp").agg(*_run_state("first_token", "last_token", "start", "end", "total", "n")).drop("grp")
    return runs.where(~at_edge).unionByName(stitched)


def token_span_merge(best: DataFrame, texts: DataFrame | None = None, text_col: str = "text", problem_type: str | None = None, chunk: int = RUN_CHUNK) -> DataFrame:
    """M5: one detection for each run of adjacent tokens with the same label.

    span = first start .. last end, score = mean prob, text = that slice of the content in
    ``texts`` (content_id and ``text_col``), whatever the tokenizer.

    ``best`` may also have an array ``best`` of a content's labelled tokens, in order, and its ``text_col``, with
    one row per content: runs and slices are then made in the row, without a shuffle.
    """
    if "best" in best.columns:
        spans = best.where(F.col("content_id").isNotNull()).select("content_id", F.inline_outer(_spans_in_row(text_col, "best")))
        return spans.where(F.col("first_token").isNotNull()).select(
            "content_id", "first_token", "start", "end", "text", F.lit(problem_type or "detection").alias("detection"), F.col("label").alias("detection_type"), "score"
        )
    text = texts.select("content_id", F.col(text_col).alias("_t"))
    spans = token_runs(best, chunk).join(text, "content_id")
    return spans.select(
        "content_id",
        "first_token",
        F.col("start").cast("int").alias("start"),
        F.col("end").cast("int").alias("end"),
        F.expr("substring(_t, start + 1, `end` - start)").alias("text"),
        F.lit(problem_type or "detection").alias("detection"),
        F.col("label").alias("detection_type"),
        (F.col("total") / F.col("n")).alias("score"),
    )


def is_scored(max_length: Column | int, model_max: int | None = None) -> Column:
    """Whether a token is among the first ``max_length``; a model max of 1e6 or more means unbounded."""
    n = max_length if isinstance(max_length, Column) else F.lit(int(max_length))
    if model_max and model_max < UNBOUNDED_MODEL_MAX:
        n = F.least(n, F.lit(int(model_max)))
    return F.col("token_idx") < n


def truncate_tokens(tokens: DataFrame, max_length: Column | int, model_max: int | None = None) -> DataFrame:
    """The tokens that are scored."""
    return tokens.where(is_scored(max_length, model_max))


# --- M7 / M8 / M9 / M10 generation-based risk --------------------------------------------


def topk_candidates(cands: DataFrame, k: int = TOPK) -> DataFrame:
    """Top-k candidates per (content, risk, step), last generated step dropped."""
    w = Window.partitionBy("content_id", "risk", "step").orderBy(F.col("logprob").desc(), F.col("token"))
    last = Window.partitionBy("content_id", "risk")
    return (
        cands.withColumn("rank", F.row_number().over(w))
        .withColumn("last_step", F.max("step").over(last))
        .where((F.col("rank") <= k) & (F.col("step") < F.col("last_step")))
        .drop("last_step")
    )


def token_logprob_risk(top: DataFrame, safe_token: str = SAFE_TOKEN, unsafe_token: str = UNSAFE_TOKEN) -> DataFrame:
    """Probability of risk per (content, risk): unsafe / (safe + unsafe) of summed candidate probs.

    Each sum starts at 1e-50; a candidate counts when its trimmed, lower-cased
    text equals the word. Contents without candidates get 0.5.
    """
    t = F.lower(F.trim(F.col("token")))
    p = F.exp("logprob")
    agg = top.groupBy("content_id", "risk").agg(
        F.sum(F.when(t == safe_token.lower(), p).otherwise(0.0)).alias("safe_p"),
        F.sum(F.when(t == unsafe_token.lower(), p).otherwise(0.0)).alias("unsafe_p"),
    )
    s = F.col("safe_p") + F.lit(PRIOR)
    u = F.col("unsafe_p") + F.lit(PRIOR)
    return agg.select("content_id", "risk", (u / (s + u)).alias("prob_of_risk"), (s / (s + u)).alias("prob_safe"))


def verdict_label(decoded: Column, safe_token: str = SAFE_TOKEN, unsafe_token: str = UNSAFE_TOKEN) -> Column:
    """Decoded answer (trimmed, lower-cased) -> the safe/unsafe word, else ``failed``."""
    d = F.lower(F.trim(decoded))
    return F.when(d == unsafe_token.lower(), F.lit(unsafe_token)).when(d == safe_token.lower(), F.lit(safe_token)).otherwise(F.lit("failed"))


def greedy_decode(cands: DataFrame) -> DataFrame:
    """Greedy answer per (content, risk): the best candidate of every step, in step order.

    The candidates of a step may also come as an array ``candidates`` of (logprob, token): then its best
    one is found in the row, and that alone is sorted and shuffled.
    """
    one = F.array_max("candidates") if "candidates" in cands.columns else F.struct(F.col("logprob"), F.col("token"))
    best = cands.select("content_id", "risk", "step", one.alias("b")).groupBy("content_id", "risk", "step").agg(F.max("b").alias("b"))
    return best.groupBy("content_id", "risk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", F.col("b.token").alias("token")))), lambda x: x["token"]), "").alias("decoded")
    )
