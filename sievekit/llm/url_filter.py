"""URL filter: host and path rules, then a ratio of two character language models.

Rules decide first: a rule fits its host and all subdomains if the path starts
with the rule's path, and the longest fitting rule wins. The other URLs are
judged by two variable-order Markov models, one of accepted and one of rejected
URLs, over the whole URL: scheme, host in lower case, path, query and fragment, or the raw
text if it has no ``://``. Each model mixes orders 0 to ``ORDER`` by Witten-Bell smoothing and keeps
only contexts seen at least ``MIN_CONTEXT`` times, so the order used varies with
what was seen. The score is the difference of the two log-likelihoods divided by
the length; a URL is blocked below a threshold set on held-out accepted URLs so
that about ``FALSE_BLOCK`` of them would be lost.

The models count every distinct URL that a rule decides, but a fifth by hash; all accepted ones
of that fifth set the threshold. Tasks count, Spark adds up (side, order, gram), and only grams of contexts
that are kept reach the driver: their number follows the kinds of five bytes in URLs, not the table.

Edge cases: null or no ``://`` gives empty host and path and no rule fits; a URL
without characters, or null, scores 0 and is allowed; with too few URLs of one side every URL
is allowed; an empty table gives no rows; other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import ascii_lower, bound_batches

ORDER = 4
MIN_CONTEXT = 2
FALSE_BLOCK = 0.01
HELD_OUT = 5
START = 1  # pads the contexts of the first characters


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    allow: bool

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    Rule("com", "/", True),
    Rule("example.com", "/en/", False),
    Rule("www.example.com", "/en/", True),
    Rule("net", "/es/", False),
    Rule("net", "/fr/", False),
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def whole_of(url: Column) -> Column:
    """What the models see: all of the URL with its host as ``host_of`` gives it."""
    around = [F.regexp_extract(url, p, 1) for p in (r"(?s)^(.*?://)", r"(?s)^.*?://[^/?#]*(.*)\z")]
    return F.coalesce(F.when(url.contains("://"), F.concat(around[0], host_of(url), around[1])).otherwise(url), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The longest fitting rule as struct(text, allow), or null."""
    out = F.lit(None).cast("struct<text:string,allow:boolean>")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.allow).alias("allow"))).otherwise(out)
    return out


def _grams(urls: list[bytes]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Lengths, and for each order k the key of (k characters of context, character) at every place."""
    lengths = np.fromiter(map(len, urls), np.int64, len(urls))
    pad = bytes([START]) * ORDER
    flat = np.frombuffer(b"".join(pad + u for u in urls), np.uint8).astype(np.uint64)
    ends = np.cumsum(lengths + ORDER)
    owner = np.repeat(np.arange(len(urls)), lengths)
    places = np.arange(len(owner)) + ORDER * (owner + 1)
    keys, key = [], np.zeros(len(owner), np.uint64)
    for k in range(ORDER + 1):
        key = key | (flat[places - k] << np.uint64(8 * k)) if len(owner) else key
        keys.append(key)
    assert not len(urls) or ends[-1] == len(flat)
    return lengths, keys, owner


class MarkovModel:
    """Counts of every order as sorted arrays; the last character is a key's low byte."""

    def __init__(self, urls: list[bytes], min_context: int = MIN_CONTEXT):
        _, keys, _ = _grams(urls)
        self._set([np.unique(key, return_counts=True) for key in keys], min_context)

    @classmethod
    def of_counts(cls, counted: list[tuple[np.ndarray, np.ndarray]], min_context: int = MIN_CONTEXT) -> MarkovModel:
        """The model of (sorted grams, their counts) of every order."""
        model = cls.__new__(cls)
        model._set(counted, min_context)
        return model

    def _set(self, counted: list[tuple[np.ndarray, np.ndarray]], min_context: int) -> None:
        self.orders = []
        for k, (gram, count) in enumerate(counted):
            context, first = np.unique(gram >> np.uint64(8), return_index=True)
            total = np.add.reduceat(count, first) if len(first) else count
            kinds = np.diff(np.append(first, len(gram)))
            if k:  # rarely seen contexts fall back to the next shorter order
                kept = total >= min_context
                context, total, kinds = context[kept], total[kept], kinds[kept]
            self.orders.append((gram, count.astype(float), context, total.astype(float), kinds.astype(float)))

    @staticmethod
    def _find(sorted_keys: np.ndarray, values: list[np.ndarray], key: np.ndarray) -> list[np.ndarray]:
        if not len(sorted_keys):
            return [np.zeros(len(key)) for _ in values]
        at = np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)
        hit = sorted_keys[at] == key
        return [np.where(hit, v[at], 0.0) for v in values]

    def log_probs(self, keys: list[np.ndarray]) -> np.ndarray:
        p = np.full(len(keys[0]), 1 / 256)
        for (gram, count, context, total, kinds), key in zip(self.orders, keys, strict=True):
            (n,) = self._find(gram, [count], key)
            t, d = self._find(context, [total, kinds], key >> np.uint64(8))
            known = t > 0
            p = np.where(known, (n + d * p) / np.where(known, t + d, 1), p)
        return np.log(p)


@dataclass
class UrlModel:
    accepted: MarkovModel
    rejected: MarkovModel
    threshold: float

    def scores(self, urls: list[bytes]) -> np.ndarray:
        """Log-likelihood difference per character, positive for accepted."""
        lengths, keys, owner = _grams(urls)
        gap = self.accepted.log_probs(keys) - self.rejected.log_probs(keys)
        return np.bincount(owner, gap, len(urls)) / np.maximum(lengths, 1)


def fit(accepted: list[bytes], rejected: list[bytes], false_block: float = FALSE_BLOCK) -> UrlModel | None:
    """Fits both models on four fifths of each side and sets the threshold on the rest."""
    if len(accepted) < HELD_OUT or len(rejected) < HELD_OUT:
        return None
    train = lambda urls: [u for i, u in enumerate(urls) if i % HELD_OUT]
    model = UrlModel(MarkovModel(train(accepted)), MarkovModel(train(rejected)), 0.0)
    held = np.sort(model.scores(accepted[::HELD_OUT]))
    # Never above 0: a URL likelier under the accepted model is not blocked.
    model.threshold = min(0.0, float(held[int(false_block * len(held))]))
    return model


COUNTED = "allow boolean, k int, gram long, n long"


def gram_counts(known: DataFrame, min_context: int = MIN_CONTEXT) -> DataFrame:
    """(allow, k, gram, n) of all URLs of (url, allow), but for contexts seen less than ``min_context`` times."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = np.asarray(batch.column("allow").to_pylist(), bool)
            urls = batch.column("url").to_pylist()
            for allow in (True, False):
                _, keys, _ = _grams([urls[i].encode() for i in np.flatnonzero(sides == allow)])
                for k, key in enumerate(keys):
                    gram, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), allow)), pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.astype(np.int64)), pa.array(n.astype(np.int64))], ["allow", "k", "gram", "n"])

    summed = known.select("url", "allow").mapInArrow(count, COUNTED).groupBy("allow", "k", "gram").agg(F.sum("n").alias("n"))
    context = F.shiftrightunsigned("gram", 8)
    seen = summed.groupBy("allow", "k", context.alias("context")).agg(F.sum("n").alias("seen")).where((F.col("seen") >= min_context) | (F.col("k") == 0))
    kept = summed.withColumn("context", context).join(seen, ["allow", "k", "context"])
    return kept.select("allow", "k", "gram", "n")


def fit_all(known: DataFrame, false_block: float = FALSE_BLOCK) -> UrlModel | None:
    """As ``fit``, of all distinct URLs of a frame (url, allow)."""
    known = known.where(F.col("allow").isNotNull()).distinct()
    sides = {r["allow"]: r["count"] for r in known.groupBy("allow").count().collect()}
    if min(sides.get(True, 0), sides.get(False, 0)) < HELD_OUT:
        return None
    held = F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0
    rows = gram_counts(known.where(~held)).orderBy("allow", "k", "gram").toArrow()
    side, order, gram, n = (rows.column(c).to_numpy() for c in ("allow", "k", "gram", "n"))

    def model_of(allow: bool) -> MarkovModel:
        mine = [(side == allow) & (order == k) for k in range(ORDER + 1)]
        return MarkovModel.of_counts([(gram[m].astype(np.uint64), n[m]) for m in mine])

    model = UrlModel(model_of(True), model_of(False), 0.0)
    scores = known.where(held & F.col("allow")).select(score_column(F.col("url"), model).alias("s"))
    lowest = scores.agg(F.percentile_approx("s", false_block, 1_000_000)).first()[0]
    # Never above 0: a URL likelier under the accepted model is not blocked.
    model.threshold = min(0.0, lowest) if lowest is not None else 0.0
    return model


def score_column(whole: Column, model: UrlModel | None) -> Column:
    @F.pandas_udf("double")
    def lm_score(urls: pd.Series) -> pd.Series:
        if model is None:
            return pd.Series(np.zeros(len(urls)))
        return pd.Series(model.scores([u.encode() for u in urls]))

    return lm_score(whole)


def judge(pages: DataFrame, model: UrlModel | None, rules: tuple[Rule, ...] = RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict and lm_score; columns of these names are replaced."""
    pages = pages.drop("host", "path", "rule", "verdict", "lm_score")

    threshold = model.threshold if model else 0.0
    ruled = pages.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    ruled = ruled.withColumn("_rule", rule_of(F.col("host"), F.col("path"), rules))
    scored = ruled.withColumn("lm_score", score_column(whole_of(F.col(url)), model))
    allowed = F.coalesce(F.col("_rule.allow"), F.col("lm_score") >= threshold)
    return (
        scored.withColumn("rule", F.col("_rule.text"))
        .withColumn("verdict", F.when(allowed, "allow").otherwise("block"))
        .drop("_rule")
    )


def fit_on_rules(pages: DataFrame, rules: tuple[Rule, ...] = RULES, url: str = "url") -> UrlModel | None:
    """Trains on all URLs that the rules decide."""
    bound_batches(pages.sparkSession)
    rule = rule_of(host_of(F.col(url)), path_of(F.col(url)), rules)
    return fit_all(pages.select(whole_of(F.col(url)).alias("url"), rule["allow"].alias("allow")))
