"""Phrase collocations from a weighted de Bruijn graph of words.

Texts are cut into pieces at marks and line ends, pieces into words. Every word of a piece starts
one longest gram: ``LONGEST`` words, or fewer where the piece ends. A gram of ``LONGEST`` words is an
edge from the node of its first words to the node of its last, which overlap; a shorter one is the
correction that a piece's end needs.

Counting. Only longest grams are counted (``edges``), pre-aggregated in each task. How often a
shorter phrase occurs is the flow out of its node: the edges that begin with it, and the pieces that
end with it. So counts go down word by word (``counted``), each level from the aggregate of the
level above, and each shuffle carries partial sums: a phrase with a third of all words is one row
for each task.

Words in grams. A word is the 64-bit hash of its language and letters; the vocabulary shows that no
two words share one (else the seed changes), so counts are exact. If the words that occur often enough
to be in a phrase are at most ``CODES``, grams hold their 21-bit codes instead (a broadcast of at most 16 MB),
and other words, which no phrase can hold, end a run of words as a mark does. Then pairs of words are
counted first, the edges of the graph whose nodes are words; if those that occur often enough are at most
``CODES``, any other ends a run as well, and only grams of three words and more are left to count. Most
of them are still seldom, and the more the table grows the more pairs join into such. So they are counted
by hash first (``often_slots``): each task counts into one array of slots, the sums over tasks say
which slots occur often enough, and a gram ends where it would fall into another. The slots grow with
the occurrences of the pairs, up to 2^``MOST_SLOTS`` (a broadcast of 16 MB); beyond that more seldom grams
share a slot with others and are counted for nothing. No phrase that counts is cut by any of that, so
all forms give the same rows. What a task hands on are then little more than the phrases that count.

Compacting. Where all flow of a phrase runs along one edge to a longer phrase, the two are one unary
path and the shorter is absorbed: it lies inside a longer candidate that occurs as often. One more
word at either end decides, since counts only fall as phrases grow.

Edge cases: null text is empty; null lang is ``und``; texts without words, and empty tables, give no
rows; repeated rows count each time; ties in score go to the larger count, then to the lesser
phrase by bytes; very long words and pieces are kept whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sievekit.llm.common import bound_batches, cut, mix64, shuffles_dropped, sliced, text_buffer, token_hashes, word_spans

LONGEST = 5
LEAST = 100  # occurrences of a candidate
FIRST = 2000  # phrases reported for each language
CODE_BITS = 21
CODES = (1 << CODE_BITS) - 1
UNKNOWN = "und"
SLICE_BYTES = 1 << 20
HELD_GRAMS = 1 << 20  # grams a task holds before it sums equal ones
SPARE = 24  # slots for as many occurrences as make a phrase count
LEAST_SLOTS, MOST_SLOTS = 12, 27  # as powers of two
BLOCKS = 256  # parts in which the tasks' slots are added
FULL = 255  # a slot counts up to it

_u = np.uint64
_STOP, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_STOP[[*b".,;:!?", 10, 11, 12, 13]] = True
_BLANK[[0x20, 9]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, start, end, row, whether the piece ends with it) of every word in order."""
    data = _LOWER.take(data)
    stop = _STOP.take(data)
    start, end, row = word_spans(~(stop | _BLANK.take(data)), offsets)
    piece = np.cumsum(stop)[start] if len(start) else start
    last = np.ones(len(start), bool)
    last[:-1] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    return data, start, end, row, last


def _tokens(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple]:
    """(batch, bytes, start, end, row, last, key) slice by slice; a word's key depends on its language."""
    for batch in batches:
        for part in sliced(batch, "text", SLICE_BYTES):
            data, start, end, row, last = words_of(*text_buffer(part.column("text")))
            if not len(start):
                continue
            langs = part.column("lang").dictionary_encode()
            codes = langs.indices.to_numpy()
            name = np.array([hash_of(x, seed) for x in langs.dictionary.to_pylist()], _u)[codes]
            key = mix64(token_hashes(data, start, end) ^ name[row])
            yield part, data, start, end, row, last, np.maximum(key, _u(1))


def hash_of(lang: str, seed: int) -> int:
    data = np.frombuffer(lang.encode() + b"\0", np.uint8)
    return int(mix64(token_hashes(data, np.array([0]), np.array([len(data)])) + _u(seed))[0])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text")


def vocabulary(docs: DataFrame) -> tuple[DataFrame, int]:
    """(lang, word, key, n of every word; the seed under which keys are unique). Cuts the lineage."""

    def run(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[pa.RecordBatch]:
        for part, data, start, end, row, _, key in _tokens(batches, seed):
            key, first, n = np.unique(key, return_index=True, return_counts=True)
            raw = data.tobytes()
            words = [raw[i:j].decode() for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            lang = part.column("lang").take(pa.array(row[first]))
            yield pa.RecordBatch.from_arrays([lang, pa.array(words), pa.array(key.view(np.int64)), pa.array(n)], ["lang", "word", "key", "n"])

    for seed in count():
        found = _texts(docs).mapInArrow(lambda b, seed=seed: run(b, seed), "lang string, word string, key long, n long")
        words = cut(found.groupBy("lang", "word", "key").agg(F.sum("n").alias("n")))
        if words.groupBy("key").count().where("count > 1").isEmpty():
            return words, seed


class Packed:
    """Grams of codes of ``CODE_BITS`` bits: three in ``head``, the first in the highest bits, then
    the fourth and the fifth word."""

    names, node = ("head", "fourth", "fifth"), ("head", "fourth")
    schema = "head long, fourth int, fifth int, f long"
    kinds = (np.int64, np.int32, np.int32)

    @staticmethod
    def pack(words: list[np.ndarray]) -> list[np.ndarray]:
        shift = _u(CODE_BITS)
        head = (((words[0] << shift) | words[1]) << shift) | words[2]
        return [head.view(np.int64), words[3].astype(np.int32), words[4].astype(np.int32)]

    @staticmethod
    def unpack(columns: list[np.ndarray]) -> list[np.ndarray]:
        head = columns[0].view(_u)
        return [(head >> _u(CODE_BITS * k)) & _u(CODES) for k in (2, 1, 0)] + [c.astype(_u) for c in columns[1:]]

    @staticmethod
    def has(nth: int) -> Column:
        if nth > 3:
            return F.col(Packed.names[nth - 3]) != 0
        return F.shiftright("head", CODE_BITS * (3 - nth)).bitwiseAND(CODES) != 0

    @staticmethod
    def first(n: int) -> list[Column]:
        """The first n words of a gram of n + 1."""
        head = F.col("head") if n >= 3 else F.col("head").bitwiseAND(F.lit(-(1 << (CODE_BITS * (3 - n)))))
        fourth = F.col("fourth") if n >= 4 else F.lit(0)
        return [head.alias("head"), fourth.alias("fourth"), F.lit(0).alias("fifth")]


class Wide:
    """Grams of whole keys, a column for each word."""

    names = tuple(f"w{k}" for k in range(1, LONGEST + 1))
    node = names[:-1]
    schema = ", ".join(f"{w} long" for w in names) + ", f long"
    kinds = (np.int64,) * LONGEST

    @staticmethod
    def pack(words: list[np.ndarray]) -> list[np.ndarray]:
        return [w.view(np.int64) for w in words]

    @staticmethod
    def unpack(columns: list[np.ndarray]) -> list[np.ndarray]:
        return [c.view(_u) for c in columns]

    @staticmethod
    def has(nth: int) -> Column:
        return F.col(f"w{nth}") != 0

    @staticmethod
    def first(n: int) -> list[Column]:
        return [(F.col(w) if k < n else F.lit(0).cast("long")).alias(w) for k, w in enumerate(Wide.names)]


def longest_grams(word: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """For each word, it and the words after it in its run, as ``LONGEST`` arrays with 0 beyond the
    run's end. A word of 0 ends a run and is in none."""
    ends = last | (word == 0)
    ends[:-1] |= word[1:] == 0
    ends[-1:] = True
    at = np.flatnonzero(ends)
    i = np.flatnonzero(word)
    room = at[np.searchsorted(at, i)] - i
    padded = np.concatenate([word, np.zeros(LONGEST, word.dtype)])
    return [np.where(room >= k, padded[i + k], 0).astype(_u) for k in range(LONGEST)]


def summed(form: type, held: list[tuple[list[np.ndarray], np.ndarray]]) -> pa.RecordBatch:
    """One row for each distinct gram, with the sum of its counts."""
    columns = [np.concatenate(c) for c in zip(*(grams for grams, _ in held), strict=True)]
    f = np.concatenate([n for _, n in held])
    order = np.lexsort(columns[::-1])
    columns, f = [c[order] for c in columns], f[order]
    new = np.zeros(len(f), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    at = np.flatnonzero(new)
    return pa.RecordBatch.from_arrays([*(pa.array(c[at].astype(k)) for c, k in zip(columns, form.kinds, strict=True)), pa.array(np.add.reduceat(f, at))], [*form.names, "f"])


def within(known: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is there) of values in a sorted list that is not empty."""
    at = np.minimum(np.searchsorted(known, value), len(known) - 1)
    return at, known[at] == value


class Pairs:
    """Grams of two coded words in one long; 0 at the end of a run."""

    names, schema, kinds = ("pair",), "pair long, f long", (np.int64,)

    @staticmethod
    def of(word: np.ndarray, last: np.ndarray) -> np.ndarray:
        follows = np.concatenate([word[1:], np.zeros(1, _u)])
        return np.where(last | (word == 0) | (follows == 0), 0, (word << _u(CODE_BITS)) | follows).astype(_u)


def _coded(batches: Iterator[pa.RecordBatch], seed: int, codes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, last) slice by slice; a word is its code, or 0 without one, if there are codes, else its key."""
    for *_, last, word in _tokens(batches, seed):
        if codes is not None:
            at, there = within(codes.value, word)
            word = np.where(there, at + 1, 0).astype(_u)
        yield word, last


def linked_grams(word: np.ndarray, last: np.ndarray, pairs: np.ndarray) -> list[np.ndarray]:
    """The longest grams of three words and more whose pairs are all known."""
    words = longest_grams(word, ~within(pairs, Pairs.of(word, last))[1])
    long = words[2] > 0
    return [w[long] for w in words]


def slots_of(words: list[np.ndarray], bits: int) -> list[np.ndarray]:
    """The slots, out of 2^bits, of the first three, four and five words of each gram."""
    names = [mix64(Packed.pack(words)[0].view(_u))]
    for w in words[3:]:
        names.append(mix64(names[-1] ^ w))
    return [(name >> _u(64 - bits)).astype(np.int64) for name in names]


def often_slots(docs: DataFrame, codes, pairs, seed: int, least: int, bits: int) -> np.ndarray:
    """A packed bit for each of 2^bits slots: whether its grams of three linked words and more occur
    ``least`` times together. A gram that does has its bit; a seldom one may share a slot with others.

    A task hands on its slots in ``BLOCKS`` rows of a byte for each slot, however many grams it has read;
    sums stop at ``FULL``, where a slot counts as often enough for any ``least``. A task holds
    2^``MOST_SLOTS`` bytes at most, the driver an eighth of that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, np.uint8)
        for word, last in _coded(batches, seed, codes):
            words = linked_grams(word, last, pairs.value)
            whole = [slot[w > 0] for slot, w in zip(slots_of(words, bits), words[2:], strict=True)]
            slot, n = np.unique(np.concatenate(whole), return_counts=True)
            seen[slot] = np.minimum(seen[slot] + n, FULL)
        for block, part in enumerate(seen.reshape(BLOCKS, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([part.tobytes()])], ["block", "seen"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, part in zip(batch.column("block").to_pylist(), batch.column("seen"), strict=True):
                more = total.get(block, np.uint16(0)) + np.frombuffer(part.as_buffer(), np.uint8)
                total[block] = np.minimum(more, FULL).astype(np.uint16)
        for block, n in total.items():
            bit = np.packbits(n >= min(least, FULL), bitorder="little").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([bit])], ["block", "often"])

    parts = _texts(docs).mapInArrow(run, "block int, seen binary").repartition("block")
    often = np.zeros((BLOCKS, (1 << bits) // BLOCKS // 8), np.uint8)
    for r in parts.mapInArrow(add, "block int, often binary").collect():
        often[r["block"]] = np.frombuffer(r["often"], np.uint8)
    return often.ravel()


def cut_at_slots(words: list[np.ndarray], often: np.ndarray) -> list[np.ndarray]:
    """Linked grams, each ended where a gram within it isn't in a slot that is often enough; those of two words left out."""

    def after(there: np.ndarray) -> np.ndarray:
        # A gram of four words and more is followed by the one that begins with its second word.
        return np.concatenate([there, np.zeros(1, bool)])[1:]

    bits = (8 * len(often)).bit_length() - 1
    three, four, five = (((often[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0) & (w > 0) for slot, w in zip(slots_of(words, bits), words[2:], strict=True))
    to_fourth = three & four & after(three)
    to_fifth = to_fourth & five & after(four)
    ended = [*words[:3], np.where(to_fourth, words[3], 0).astype(_u), np.where(to_fifth, words[4], 0).astype(_u)]
    return [w[three] for w in ended]


def edges(docs: DataFrame, form: type, codes, pairs, seed: int, often=None) -> DataFrame:
    """The grams of all texts in a form, summed within tasks; ``codes`` has the sorted keys of
    words that have codes (a broadcast of at most ``CODES`` longs), ``pairs`` the sorted pairs that
    occur often enough (as many at most), ``often`` the bits of ``often_slots``, for longer grams of
    such pairs. Any may be None."""

    def grams_of(word: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        if form is Pairs:
            pair = Pairs.of(word, last)
            return [pair[pair > 0].view(np.int64)]
        if pairs is None:
            return form.pack(longest_grams(word, last))
        # Words and pairs have their counts; only longer grams are left.
        words = linked_grams(word, last, pairs.value)
        return form.pack(words if often is None else cut_at_slots(words, often.value))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for word, last in _coded(batches, seed, codes):
            grams = grams_of(word, last)
            held.append((grams, np.ones(len(grams[0]), np.int64)))
            size += len(grams[0])
            if size >= HELD_GRAMS:
                yield summed(form, held)
                held, size = [], 0
        if size:
            yield summed(form, held)

    return _texts(docs).mapInArrow(run, form.schema)


def counted(grams: DataFrame, form: type, least: int, shortest: int) -> DataFrame:
    """(the form's columns, level, f) of every phrase of ``shortest`` to ``LONGEST`` words that occurs ``least`` times.

    Level 0 is the flow on its way down. A row of level n is a phrase of n words with its whole
    count: it was found, and goes on beside the flow untouched.
    """
    total = F.sum("f").alias("f")
    flow = grams.repartition(*form.node).groupBy(*form.names).agg(total).withColumn("level", F.lit(0))
    for n in range(LONGEST, shortest - 1, -1):
        out = [c for c in form.names if c not in form.node] if n == LONGEST else list(form.names)
        deep, found = F.col("level") > 0, form.has(n) & (F.col("f") >= least)
        # The nodes of edges keep their column, so that the first step down needs no shuffle.
        stay = [c for c in form.names if c not in out]
        whole = F.struct(*out, F.when(deep, F.col("level")).otherwise(F.lit(n)).alias("level"), "f")
        if n == shortest:
            flow = flow.where(deep | found).select(F.inline(F.array(whole)))
            break
        shorter = [c for c, name in zip(form.first(n - 1), form.names, strict=True) if name in out]
        shorter = F.struct(*shorter, F.lit(0).alias("level"), "f")
        rows = F.when(deep, F.array(whole)).when(found, F.array(whole, shorter)).otherwise(F.array(shorter))
        flow = flow.select(*stay, F.inline(rows)).groupBy(*form.names, "level").agg(total)
    return flow


def _broadcast(spark: SparkSession, values: DataFrame, most: int):
    """The longs of a column, sorted, as a broadcast; None if there are more than ``most``."""
    if values.count() > most:
        return None
    known = np.sort(np.array([r[0] for r in values.collect()], np.int64).view(_u))
    return spark.sparkContext.broadcast(known if len(known) else np.zeros(1, _u))


def frequent_phrases(docs: DataFrame, least: int = LEAST, most_codes: int = CODES) -> tuple[DataFrame, DataFrame]:
    """(words (array of keys), f) of all phrases that occur ``least`` times, and the vocabulary. Cuts the lineage."""
    spark = docs.sparkSession
    bound_batches(spark)
    words, seed = vocabulary(docs)
    often = words.where(F.col("n") >= least)
    codes, pairs, slots, form = _broadcast(spark, often.select("key"), most_codes), None, None, Wide
    if codes is not None:
        form = Packed
        linked = edges(docs, Pairs, codes, None, seed).groupBy("pair").agg(F.sum("f").alias("f"))
        linked = cut(linked.where(F.col("f") >= least))
        pairs = _broadcast(spark, linked.select("pair"), most_codes)
    if pairs is not None:
        wanted = SPARE * (linked.agg(F.sum("f")).first()[0] or 0) // least
        bits = min(max(wanted.bit_length(), LEAST_SLOTS), MOST_SLOTS)
        slots = spark.sparkContext.broadcast(often_slots(docs, codes, pairs, seed, least, bits))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = form.unpack([batch.column(c).to_numpy() for c in form.names])
            if codes is not None:
                columns = [codes.value[np.maximum(c, _u(1)) - _u(1)] for c in columns]
            level = batch.column("level").to_numpy()
            flat = np.stack(columns, axis=1)[np.arange(LONGEST)[None, :] < level[:, None]]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(level)]), pa.int32()), pa.array(flat.view(np.int64)))
            yield pa.RecordBatch.from_arrays([lists, batch.column("f")], ["words", "f"])

    shortest = 1 if pairs is None else 3
    found = counted(edges(docs, form, codes, pairs, seed, slots), form, least, shortest).mapInArrow(named, "words array<long>, f long")
    if pairs is not None:
        head, level = F.shiftleft("pair", CODE_BITS), F.lit(2).alias("level")
        two = linked.select(head.alias("head"), F.lit(0).alias("fourth"), F.lit(0).alias("fifth"), level, "f")
        found = found.unionByName(two.mapInArrow(named, "words array<long>, f long"))
        found = found.unionByName(often.select(F.array("key").alias("words"), F.col("n").alias("f")))
    return cut(found), words


def compacted(candidates: DataFrame) -> DataFrame:
    """Candidates (words, f) that no longer candidate with the same count holds."""
    size = F.size("words")
    ends = F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))
    longer = candidates.where(size > 2).select(F.explode(ends).alias("words"), F.col("f").alias("longer"))
    longer = longer.groupBy("words").agg(F.max("longer").alias("longer"))
    return candidates.join(longer, "words", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("f"))).drop("longer")


def collocations(docs: DataFrame, least: int = LEAST, first: int = FIRST, most_codes: int = CODES) -> DataFrame:
    """The first ``first`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    with shuffles_dropped(docs.sparkSession):
        phrases, vocab = frequent_phrases(docs, least, most_codes)
    kept = compacted(phrases.where(F.size("words") > 1))
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumn("head", F.slice("words", F.lit(1), F.col("k")))
    cuts = cuts.withColumn("rest", F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")))
    for part, name in (("head", "l"), ("rest", "r")):
        cuts = cuts.join(phrases.select(F.col("words").alias(part), F.col("f").alias(name)), part)
    sizes = vocab.groupBy("lang").agg(F.sum("n").alias("n"))
    known = vocab.where(F.col("n") >= least).select("key", "lang", "word")
    cuts = cuts.withColumn("key", F.col("words")[0]).join(known.select("key", "lang"), "key").join(sizes, "lang")
    score = F.expr("(1000 * cast(f AS decimal(38,0)) * n) div (cast(l AS decimal(38,0)) * r)")
    best = cuts.withColumn("score", score.cast("long")).groupBy("words", "f", "lang", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    best = best.select("words", "lang", F.col("f").alias("a"), "n", "cut.score", "cut.l", "cut.r")
    spelled = best.select("*", F.posexplode("words").alias("at", "key")).join(known.select("key", "word"), "key")
    phrase = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ")
    spelled = spelled.groupBy("words", "lang", "a", "n", "score", "l", "r").agg(phrase.alias("phrase"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = spelled.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
