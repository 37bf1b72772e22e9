"""Language identification with a byte convolutional network.

Texts are cut into windows of ``WINDOW`` bytes; every byte of every text falls in
one. Bytes map to ``CODES`` codes (letters without case, space, digits, marks,
and the high bytes of UTF-8), codes to a small embedding, and filters of widths
2, 3 and 4 slide over it. Each filter's maximum over the window, after a ReLU,
feeds a softmax over the languages seen in training. A text's probabilities are
the mean over its windows, weighted by their bytes.

Training is plain numpy (Adam), in two parts. A start is trained on the driver, over a bounded sample:
windows of ``SAMPLE_DOCS`` distinct labelled texts of each language (all, if it has fewer), those of the
smallest hash, ``SAMPLE_WINDOWS`` windows of each, at hashed places of the text. Then every task goes on
from there over all windows of its share of all distinct labelled texts (``refine``), some of them once more
with their ends cut off, and the network is the mean of what the tasks learned, weighted by their windows. A
window counts inversely to how many its language has, up to ``MOST_WEIGHT``. The driver gets a few kilobytes of
each task. Shares are by hash and ordered, so a rerun with as many partitions learns the same. For
prediction, embedding and filters are multiplied out into tables by pairs of codes,
so a window costs a few table reads per byte, in blocks that bound memory.

Rejection. With ``reject`` the network learns one more class, from made-up windows of digits,
hashes, keys, marks, random letters and scripts that no label stands for (``junk``). A text whose
mean probability of that class is above ``limit`` gets ``und``. The limit is calibrated on all distinct
labelled texts: at most ``FALSE_REJECT`` of them are lost, and none below ``LEAST_LIMIT``. Whether labelled
texts use a script is counted over all of them too.

Edge cases: a text that is null or has no letter gets ``und`` with score 0; texts of
any length are read whole; with no labelled text, every text is ``und``; repeated
rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import sliced, text_buffer

WINDOW = 256
CODES = 128
EMBED = 8
FILTERS = 16
WIDTHS = (2, 3, 4)
SAMPLE_DOCS = 1500
SAMPLE_WINDOWS = 2
STEPS, BATCH, RATE = 700, 64, 4e-3
BLOCK = 64
ALL_BATCH, ALL_RATE = 256, 2e-4  # of the steps in tasks
CUT_SHARE = 0.125
SLICE_BYTES = 1 << 20
MOST_WEIGHT = 20.0
UNKNOWN = "und"
FALSE_REJECT = 0.005
LEAST_LIMIT = 0.5
JUNK_WINDOWS = 3000
# First and last letter of scripts; one that labelled texts use is no junk.
SCRIPTS = ((0x391, 0x3C9), (0x410, 0x44F), (0x5D0, 0x5EA), (0x627, 0x64A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x30FE), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


def byte_codes() -> np.ndarray:
    """Code of each byte: 0 pads; 1-26 letters; 27 blanks; 28 digits; 29 ends of sentences; 30 other
    ASCII; 31 is unused; then 32 lead bytes and 64 continuation bytes of UTF-8."""
    code = np.full(256, 30, np.uint8)
    for i in range(26):
        code[ord("a") + i] = code[ord("A") + i] = 1 + i
    code[:33] = 27
    code[ord("0") : ord("9") + 1] = 28
    code[[ord(c) for c in ".!?,;:"]] = 29
    code[0xC0:] = 32 + (np.arange(0xC0, 0x100) & 31)
    code[0x80:0xC0] = 64 + (np.arange(64))
    return code


BYTE_CODE = byte_codes()


def to_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes as (windows, WINDOW), row of each window, bytes in each window)."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = offsets[:-1][owner] + nth * WINDOW
    held = np.minimum(WINDOW, offsets[1:][owner] - start)
    codes = np.zeros((len(owner), WINDOW), np.uint8)
    # Row-major order of the cells that hold a byte is the order of the bytes themselves.
    codes[np.arange(WINDOW)[None, :] < held[:, None]] = BYTE_CODE[data]
    return codes, owner, held


@dataclass
class ByteCnn:
    languages: list[str]
    embedding: np.ndarray
    filters: list[np.ndarray]  # one (width, EMBED, FILTERS) for each width
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray
    limit: float = 1.0  # of the probability of UNKNOWN, if that is a class
    _tables: tuple | None = field(default=None, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_tables": None}

    def _by_code(self) -> tuple:
        """Filters applied to codes and to pairs of codes."""
        if self._tables is None:
            one = [[self.embedding @ f[k] for k in range(len(f))] for f in self.filters]

            def pair(w: int, k: int) -> np.ndarray:
                return (one[w][k][:, None, :] + one[w][k + 1][None, :, :]).reshape(CODES * CODES, FILTERS)

            first = np.hstack([pair(0, 0), pair(1, 0), pair(2, 0)]) + self.bias
            self._tables = tuple(np.ascontiguousarray(t, np.float32) for t in (first, one[1][2], pair(2, 2)))
        return self._tables

    def pooled(self, codes: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
        """Each filter's maximum over every window: (windows, filters); ``places`` gets where it is."""
        first, third, second_pair = self._by_code()
        pooled = np.empty((len(codes), 3 * FILTERS), np.float32)
        for at in range(0, len(codes), BLOCK):
            block = codes[at : at + BLOCK].astype(np.int32)
            pairs = block[:, :-1] * CODES + block[:, 1:]
            out = first.take(pairs, axis=0)
            out[:, :-1, FILTERS : 2 * FILTERS] += third.take(block[:, 2:], axis=0)
            out[:, :-2, 2 * FILTERS :] += second_pair.take(pairs[:, 2:], axis=0)
            # The last places have no whole triple or quadruple.
            out[:, -1:, FILTERS : 2 * FILTERS] = 0
            out[:, -2:, 2 * FILTERS :] = 0
            if places is None:
                pooled[at : at + BLOCK] = out.max(axis=1)
            else:
                where = places[at : at + BLOCK] = out.argmax(axis=1)
                pooled[at : at + BLOCK] = np.take_along_axis(out, where[:, None, :], 1)[:, 0]
        return pooled

    def probabilities(self, codes: np.ndarray) -> np.ndarray:
        """Softmax of every window: (windows, languages)."""
        return self.softmax(np.maximum(self.pooled(codes), 0))

    def softmax(self, h: np.ndarray) -> np.ndarray:
        logits = h @ self.weights + self.offset
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def mean_probabilities(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages): means over the windows of each text, by bytes; 0 without bytes."""
        total = np.zeros((len(offsets) - 1, len(self.languages)))
        step = 4096  # texts are taken in groups of whole windows, a long text over several
        codes, owner, held = to_windows(data, offsets)
        for at in range(0, len(codes), step):
            p = self.probabilities(codes[at : at + step]) * held[at : at + step, None]
            mine = owner[at : at + step]
            first = np.flatnonzero(np.diff(mine, prepend=-1))
            total[mine[first]] += np.add.reduceat(p, first, axis=0)
        return total / np.maximum(np.diff(offsets), 1)[:, None]

    def classify(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language index, score, probability of UNKNOWN) of every text; a text without bytes scores 0."""
        p = self.mean_probabilities(data, offsets)
        own = np.array([x == UNKNOWN for x in self.languages])
        rejected = np.minimum(1.0, p[:, own].sum(axis=1))
        best = np.where(own, -1.0, p).argmax(axis=1)
        return best, np.minimum(1.0, p[np.arange(len(p)), best]), rejected


def foreign_scripts(known: DataFrame) -> list[tuple[int, int]]:
    """SCRIPTS that at most one in 200 of the distinct texts use: with ten letters, and one in 25."""

    def uses(low: int, high: int) -> Column:
        letters = F.regexp_count("text", F.lit(f"[{chr(low)}-{chr(high)}]"))
        return F.when((letters >= 10) & (letters * 25 >= F.length("text")), 1).otherwise(0)

    # Most texts hold no letter of any of them, and are read once.
    some = F.col("text").rlike(f"[{chr(SCRIPTS[0][0])}-{chr(SCRIPTS[-1][1])}]")
    flags = [F.when(some, uses(*s)).otherwise(0).alias(f"s{k}") for k, s in enumerate(SCRIPTS)]
    names = [f"s{k}" for k in range(len(SCRIPTS))]
    texts = known.select("lang", "h", *flags).groupBy("lang", "h").agg(*[F.max(s).alias(s) for s in names])
    found = texts.agg(F.count("*").alias("n"), *[F.sum(s).alias(s) for s in names]).first()
    return [s for s, name in zip(SCRIPTS, names, strict=True) if (found[name] or 0) <= found["n"] // 200]


def junk(scripts: list[tuple[int, int]], n: int = JUNK_WINDOWS, seed: int = 5) -> list[bytes]:
    """Windows of no language: digits, hashes, keys, marks and random letters, alone and mixed,
    and letters of ``scripts`` that labelled texts do not use."""
    rng = np.random.default_rng(seed)
    digits, marks = list("0123456789"), list("!\"#$%&'()*+,-./:;<=>?@[]^_{|}~")
    small = list("abcdefghijklmnopqrstuvwxyz")
    alphabets = [(digits, 3), (digits + small[:6], 3), (small + [c.upper() for c in small] + digits + list("+/_-"), 3), (marks, 2), (digits + marks, 2), (small, 1)]
    for low, high in scripts:
        alphabets.append(([chr(low + int(k)) for k in rng.integers(0, high - low + 1, 200)], 1))
    weight = np.array([w for _, w in alphabets], float)
    out = []
    for _ in range(n):
        kinds = rng.choice(len(alphabets), rng.integers(1, 4), p=weight / weight.sum())
        longest = int(rng.choice([4, 8, 16, 40, WINDOW]))
        words, size = [], 0
        while size < WINDOW:
            word = "".join(rng.choice(alphabets[rng.choice(kinds)][0], rng.integers(max(1, longest // 2), longest + 1)))
            words.append(word)
            size += len(word.encode()) + 1
        out.append(str(rng.choice([" ", " ", "\n", ", "])).join(words).encode()[:WINDOW])
    return out


def train(texts: list[bytes], labels: list[str], seed: int = 4) -> ByteCnn | None:
    """Fits the network on labelled windows; a random part of each is cut off, for short texts."""
    languages = sorted(set(labels))
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    codes, owner, held = to_windows(np.frombuffer(b"".join(texts), np.uint8), offsets)
    y = np.array([languages.index(x) for x in labels])[owner]
    by_class = [np.flatnonzero(y == k) for k in range(len(languages))]
    f_all, n_lang = FILTERS * len(WIDTHS), len(languages)
    p = {
        "E": rng.normal(0, 0.5, (CODES, EMBED)), "b": np.zeros(f_all), "W": rng.normal(0, f_all**-0.5, (f_all, n_lang)), "c": np.zeros(n_lang),
    } | {f"F{w}": rng.normal(0, (w * EMBED) ** -0.5, (w, EMBED, FILTERS)) for w in WIDTHS}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2 = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        picked = np.concatenate([rng.choice(rows, -(-BATCH // n_lang)) for rows in by_class])
        x, target = codes[picked].copy(), y[picked]
        size = held[picked]
        cut = np.where(rng.random(len(size)) < 0.4, np.ceil(size * rng.random(len(size)) ** 2).astype(int), size)
        x[np.arange(WINDOW)[None, :] >= np.maximum(cut, 4)[:, None]] = 0
        rows = np.arange(len(x))[:, None]
        emb = p["E"][x]
        pooled, places = [], []
        for w in WIDTHS:
            conv = sum(emb[:, k : WINDOW - w + 1 + k] @ p[f"F{w}"][k] for k in range(w))
            where = conv.argmax(axis=1)
            places.append(where)
            pooled.append(np.take_along_axis(conv, where[:, None, :], 1)[:, 0])
        raw = np.hstack(pooled) + p["b"]
        h = np.maximum(raw, 0)
        logits = h @ p["W"] + p["c"]
        e = np.exp(logits - logits.max(1, keepdims=True))
        gl = e / e.sum(1, keepdims=True)
        gl[np.arange(len(x)), target] -= 1
        gl /= len(x)
        gh = (gl @ p["W"].T) * (raw > 0)
        g = {"W": h.T @ gl, "c": gl.sum(0), "b": gh.sum(0), "E": np.zeros_like(p["E"])}
        for i, w in enumerate(WIDTHS):
            gf, gw = gh[:, i * FILTERS : (i + 1) * FILTERS], np.zeros_like(p[f"F{w}"])
            for k in range(w):
                at = places[i] + k
                gw[k] = np.einsum("bfd,bf->df", emb[rows, at], gf)
                np.add.at(g["E"], x[rows, at], gf[:, :, None] * p[f"F{w}"][k].T[None])
            g[f"F{w}"] = gw
        for k in p:
            m1[k] += 0.1 * (g[k] - m1[k])
            m2[k] += 0.001 * (g[k] ** 2 - m2[k])
            rate = RATE * min(1.0, 3 * (1 - step / (STEPS + 1)))
            p[k] -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return ByteCnn(languages, p["E"], [p[f"F{w}"] for w in WIDTHS], p["b"], p["W"], p["c"])


class Learner:
    """Steps of Adam from a network on, by the gradient of weighted windows."""

    def __init__(self, model: ByteCnn):
        self.model = replace(model, embedding=model.embedding.copy(), filters=[f.copy() for f in model.filters], bias=model.bias.copy(), weights=model.weights.copy(), offset=model.offset.copy(), _tables=None)
        self.m1, self.m2 = ([np.zeros_like(p) for p in parameters(model)] for _ in range(2))
        self.steps = 0

    def gradient(self, codes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
        model = self.model
        places = np.empty((len(codes), FILTERS * len(WIDTHS)), np.int64)
        raw = model.pooled(codes, places)
        h = np.maximum(raw, 0)
        gl = model.softmax(h)
        gl[np.arange(len(codes)), target] -= 1
        gl *= (weight / weight.sum())[:, None]
        gh = (gl @ model.weights.T) * (raw > 0)
        ge, gf = np.zeros_like(model.embedding), [np.zeros_like(f) for f in model.filters]
        rows, nth = np.arange(len(codes))[:, None], np.arange(FILTERS)
        for i, f in enumerate(model.filters):
            mine = slice(i * FILTERS, (i + 1) * FILTERS)
            for k in range(len(f)):
                code = codes[rows, np.minimum(places[:, mine] + k, WINDOW - 1)].astype(np.int64)
                by_code = np.bincount((code * FILTERS + nth).ravel(), gh[:, mine].ravel(), CODES * FILTERS).reshape(CODES, FILTERS)
                gf[i][k] = model.embedding.T @ by_code
                ge += by_code @ f[k].T
        return [ge, *gf, gh.sum(0), h.T @ gl, gl.sum(0)]

    def step(self, codes: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        self.steps += 1
        for p, g, m1, m2 in zip(parameters(self.model), self.gradient(codes, target, weight), self.m1, self.m2, strict=True):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g**2 - m2)
            p -= ALL_RATE * (m1 / (1 - 0.9**self.steps)) / (np.sqrt(m2 / (1 - 0.999**self.steps)) + 1e-8)
        self.model._tables = None


def parameters(model: ByteCnn) -> list[np.ndarray]:
    return [model.embedding, *model.filters, model.bias, model.weights, model.offset]


def refine(known: DataFrame, model: ByteCnn, more: list[bytes]) -> ByteCnn:
    """The mean of the networks that tasks train from ``model`` on, over all windows of the distinct
    texts of ``known`` (text, lang, h) and as large a share of ``more``, windows of UNKNOWN, as one language has."""
    size = F.ceil(F.octet_length("text") / WINDOW).alias("size")
    sizes = known.select("lang", "h", size).groupBy("lang", "h").agg(F.max("size").alias("size")).groupBy("lang").agg(F.sum("size").alias("n"))
    sizes = {r["lang"]: r["n"] for r in sizes.collect()}
    mean = sum(sizes.values()) / len(sizes)
    names = [x for x in model.languages if x in sizes]
    weights = np.array([min(MOST_WEIGHT, mean / sizes.get(x, mean)) for x in model.languages], np.float32)
    n_more = -(-ALL_BATCH // len(model.languages)) if more else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner, seen = Learner(model), 0
        rng = np.random.default_rng((6, TaskContext.get().partitionId()))
        extra = to_windows(np.frombuffer(b"".join(more), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in more])]).astype(np.int64))[0]
        class_of = {x: k for k, x in enumerate(model.languages)}

        def learn(codes: np.ndarray, target: np.ndarray, held: np.ndarray) -> None:
            again = rng.choice(len(codes), int(np.ceil(len(codes) * CUT_SHARE)))
            cut = codes[again]
            cut[np.arange(WINDOW)[None, :] >= np.maximum(4, np.ceil(held[again] * rng.random(len(again)) ** 2))[:, None]] = 0
            parts, classes = [codes, cut], [target, target[again]]
            if n_more:
                parts.append(extra[rng.choice(len(extra), n_more)])
                classes.append(np.full(n_more, class_of[UNKNOWN]))
            classes = np.concatenate(classes)
            learner.step(np.concatenate(parts), classes, weights[classes])

        held = []
        for batch in batches:
            for part in sliced(batch, "text", SLICE_BYTES):
                codes, owner, size = to_windows(*text_buffer(part.column("text")))
                target = np.array([class_of[x] for x in part.column("lang").to_pylist()])[owner]
                # Windows of all texts of a part in any order, so that a step has texts of several languages.
                mixed = rng.permutation(len(codes))
                held = [np.concatenate(x) for x in zip(held, (codes[mixed], target[mixed], size[mixed]), strict=True)] if held else [codes[mixed], target[mixed], size[mixed]]
                whole = len(held[0]) // ALL_BATCH * ALL_BATCH
                for at in range(0, whole, ALL_BATCH):
                    learn(*(x[at : at + ALL_BATCH] for x in held))
                seen += len(codes)
                held = [x[whole:] for x in held]
        if held and len(held[0]):
            learn(*held)
        if seen:
            found = b"".join(p.astype(np.float32).tobytes() for p in parameters(learner.model))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([seen]), pa.array([found], pa.binary())], ["part", "n", "found"])

    texts = known.where(F.col("lang").isin(names)).dropDuplicates(["h", "text", "lang"]).sortWithinPartitions("h", "lang", "text")
    rows = sorted(texts.select("text", "lang").mapInArrow(run, "part int, n long, found binary").collect())
    learned = sum(np.frombuffer(r["found"], np.float32).astype(float) * r["n"] for r in rows) / sum(r["n"] for r in rows)
    shapes = [p.shape for p in parameters(model)]
    parts = np.split(learned.astype(np.float32), np.cumsum([int(np.prod(s)) for s in shapes])[:-1])
    e, *filters, b, w, c = (p.reshape(s) for p, s in zip(parts, shapes, strict=True))
    return ByteCnn(model.languages, e, filters, b, w, c, model.limit)


def labelled(docs: DataFrame, use: Column) -> DataFrame:
    """(text, lang, h, a hash of the text) of rows where ``use`` holds, lang is known and the text has a letter."""
    known = docs.where(use & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    return known.select("text", "lang", F.xxhash64("text", F.lit("sample")).alias("h"))


def labelled_texts(docs: DataFrame, use: Column, docs_per_lang: int = SAMPLE_DOCS) -> DataFrame:
    """(text, lang): of each language the ``docs_per_lang`` distinct ``labelled`` texts of smallest
    hash; copies count once."""
    known = labelled(docs, use)
    counts = {r["lang"]: r["count"] for r in known.select("lang", "h").distinct().groupBy("lang").count().collect()}
    if not counts:
        return known.select("text", "lang")
    # Twice the hashes that are needed, so that no task has to order all texts of a language.
    shares = {lang: min(1.0, (2 * docs_per_lang + 100) / n) for lang, n in counts.items()}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
    place = F.pmod("h", F.lit(1 << 30))
    few = known.where(place / float(1 << 30) < share[F.col("lang")]).dropDuplicates(["text", "lang"])
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(place, "h", "text"))
    return few.withColumn("nth", nth).where(F.col("nth") <= docs_per_lang).select("text", "lang")


def labelled_windows(docs: DataFrame, use: Column, docs_per_lang: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> DataFrame:
    """(piece, lang): the bounded sample for the start, windows of the ``labelled_texts``."""
    chosen = labelled_texts(docs, use, docs_per_lang)
    place = F.pmod(F.xxhash64("text", "nth"), F.greatest(F.lit(1), F.length("text") - WINDOW)) + 1
    pieces = chosen.withColumn("nth", F.explode(F.sequence(F.lit(1), F.lit(windows))))
    return pieces.select(F.substring("text", place.cast("int"), WINDOW).alias("piece"), "lang")


def fit(docs: DataFrame, use: Column, docs_per_lang: int = SAMPLE_DOCS, reject: bool = False) -> ByteCnn | None:
    """The network of all labelled texts, started on a sample; with ``reject`` it has UNKNOWN as a
    class, and a limit."""
    rows = sorted(map(tuple, labelled_windows(docs, use, docs_per_lang).collect()))
    pieces, labels = [r[0].encode()[:WINDOW] for r in rows], [r[1] for r in rows]
    if not rows:
        return None
    known = labelled(docs, use)
    if not reject:
        return refine(known, train(pieces, labels), [])
    more = junk(foreign_scripts(known))
    model = refine(known, train(pieces + more, labels + [UNKNOWN] * len(more)), more)
    rejected = judged(F.col("text"), model)["rejected"].alias("rejected")
    every = known.select("lang", "h", rejected).groupBy("lang", "h").agg(F.max("rejected").alias("rejected"))
    most = every.agg(F.percentile_approx("rejected", 1 - FALSE_REJECT, 100_000)).first()[0]
    # A little more, since sums of floats depend on what else is in a batch.
    return replace(model, limit=min(1.0, max(LEAST_LIMIT, most + 1e-4)))


def judged(text: Column, model: ByteCnn | None) -> Column:
    """struct(lang, score, rejected) of a text by the network alone."""

    @F.arrow_udf("lang string, score double, rejected double")
    def guess(texts: pa.Array) -> pa.Array:
        names = ["lang", "score", "rejected"]
        if model is None:
            zero = pa.array(np.zeros(len(texts)))
            return pa.StructArray.from_arrays([pa.nulls(len(texts), pa.string()), zero, zero], names)
        best, score, rejected = model.classify(*text_buffer(texts))
        langs = pa.array(model.languages, pa.string()).take(pa.array(best))
        return pa.StructArray.from_arrays([langs, pa.array(score), pa.array(rejected)], names)

    return guess(text)


def predict(docs: DataFrame, model: ByteCnn | None, text: str = "text") -> DataFrame:
    """Adds lang_pred and score; columns of these names are replaced."""
    lettered = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    out = docs.drop("lang_pred", "score").withColumn("_guess", judged(F.col(text), model))
    sure = lettered & F.col("_guess.lang").isNotNull() & (F.col("_guess.rejected") <= (model.limit if model else 1.0))
    return (
        out.withColumn("lang_pred", F.when(sure, F.col("_guess.lang")).otherwise(UNKNOWN))
        .withColumn("score", F.when(sure, F.col("_guess.score")).otherwise(0.0))
        .drop("_guess")
    )


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id, as text, is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
