"""Near duplicates by circulant MinHash, confirmed on full sets.

A document's set holds the hashes of its distinct ``WIDTH``-word shingles. Two documents link when
100 * intersection >= 80 * union; a group of linked ones is reported under its least doc_id.

Signature. Two permutations of the 64-bit universe give all coordinates: the first scatters a set's
shingles, the second is used over and over, shifted by one place around the circle of the universe
for each coordinate, which takes the least value. ``ROWS`` coordinates make a band, ``BANDS`` bands a
signature. Two sets of similarity s share no band with probability (1 - s^4)^32: 5 in 10^8 at 0.8.

Search. Equal sets become one node first. Nodes with an equal band form a group, and no group is
expanded into pairs:

1. Each group's members are verified against one of them, the node that meets most others over
   all bands: of a family of near copies, that which the others were made from, or one close to it.
2. Groups whose other members are then in several components go to tasks whole, with their texts.
   Members outside the group's largest component are compared there with those of all other
   components, and only links that join two components come out. A large group is dealt into blocks,
   every two of which meet in a task of their own.

So every pair of a group is compared on full sets, or its nodes are in one component already.

Edge cases: null text, or text without words, has an empty set, links with nothing and is kept. Fewer
words than ``WIDTH`` form one shingle. Repeated rows are equal sets, and rows of one doc_id with
other texts are documents of their own; ties go to the least doc_id. A row without a doc_id is
kept if its whole group has none. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import cut, likely_in, mix64, shuffles_dropped, sized, sliced, text_buffer, token_hashes, word_spans
from sievekit.llm.components import components, moved_roots
from sievekit.llm.groups import later_links, set_keys, similar, unsettled

WIDTH = 2
LEAST = 80  # percent
BANDS, ROWS = 32, 4
SLICE_BYTES = 1 << 20
ID_BYTES = 16

_u = np.uint64
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACE = mix64(np.arange(1, WIDTH + 1, dtype=_u)) | _u(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, by row and hash."""
    n = len(offsets) - 1
    data = _LOWER.take(data)
    start, end, owner = word_spans(~_BLANK.take(data), offsets)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, _u)
    word = token_hashes(data, start, end) ^ _u(seed)
    value = word[:-1] * _PLACE[0] + word[1:] * _PLACE[1]
    row = owner[:-1]
    pair = row == owner[1:]
    # The one word of a text is its shingle.
    alone = np.flatnonzero(np.bincount(owner, minlength=n)[owner] == 1)
    value = mix64(np.concatenate([value[pair], mix64(word[alone])]))
    row = np.concatenate([row[pair], owner[alone]])
    order = np.lexsort((value, row))
    row, value = row[order], value[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
    return row[new], value[new]


def signatures(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """A line of coordinates for each row that has shingles, in order of row."""
    first = np.flatnonzero(np.diff(row, prepend=-1))
    scattered = mix64(value ^ _u(0x5851F42D4C957F2D))
    out = np.empty((len(first), BANDS * ROWS), _u)
    for k in range(BANDS * ROWS):
        out[:, k] = np.minimum.reduceat(mix64(scattered - _u(k)), first)
    return out


def bands_of(signature: np.ndarray) -> np.ndarray:
    """A key for each band, which differs between bands."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=_u), (len(signature), BANDS))
    for k in range(ROWS):
        key = mix64(key * _u(0xD1342543DE82EF95) + signature[:, k::ROWS])
    return key


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in sliced(batch, "text", SLICE_BYTES):
            yield part, *text_buffer(part.column("text"))


def facts(docs: DataFrame, seed: int) -> DataFrame:
    """One row per document: doc_id, n, two keys of its set (node, proof), and the bands of sets
    that its task has not met before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set = set()
        for part, data, offsets in _texts(batches):
            size = part.num_rows
            row, value = shingle_sets(data, offsets, seed)
            n = np.bincount(row, minlength=size)
            node, proof = (set_keys(row, value, size, k).view(np.int64) for k in (0, 1))
            new = np.zeros(size, bool)
            for i in np.flatnonzero(n).tolist():
                new[i] = (key := int(node[i])) not in met
                met.add(key)
            pick = new[row]
            keys = bands_of(signatures(row[pick], value[pick])).view(np.int64) if pick.any() else np.zeros((0, BANDS), np.int64)
            ends = np.concatenate([[0], np.cumsum(new * BANDS)])
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.reshape(-1)))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(node, mask=n == 0), pa.array(proof), bands], ["doc_id", "n", "node", "proof", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long, proof long, bands array<long>")


def groups_of(known: DataFrame) -> DataFrame:
    """(key, node, lead) of the members of groups with several nodes; ``lead`` is the group's node
    that meets most. Cuts the lineage."""
    rows = known.select(F.explode("bands").alias("key"), "node")
    several = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("low"), F.max("node").alias("high"))
    several = several.where("low != high").select("key", "size")
    live = cut(rows.join(several, "key").groupBy("key", "node").agg(F.max("size").alias("size")))
    place = live.groupBy("node").agg((-F.sum("size")).alias("place"))
    lead = live.join(place, "node").groupBy("key").agg(F.min(F.struct("place", "node"))["node"].alias("lead"))
    return cut(live.select("key", "node").join(lead, "key"))


def texts_of(docs: DataFrame, known: DataFrame, members: DataFrame, seed: int) -> DataFrame:
    """(node, n, text) of every node of ``members``. Cuts the lineage."""

    def meant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A repeated doc_id may bring texts of other sets.
        for part, data, offsets in _texts(batches):
            key = set_keys(*shingle_sets(data, offsets, seed), part.num_rows, 0).view(np.int64)
            yield part.select(["node", "n", "text"]).filter(pa.array(part.column("node").to_numpy() == key))

    nodes = known.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    ids = cut(nodes.join(members.select("node").distinct(), "node"))
    texts = likely_in(docs.select("doc_id", "text"), ids, "doc_id")
    found = texts.join(sized(ids, ID_BYTES + 8), texts["doc_id"].eqNullSafe(ids["doc_id"])).select("node", "n", "text")
    return cut(found.mapInArrow(meant, "node long, n long, text string").dropDuplicates(["node"]))


def verified(pairs: DataFrame, texts: DataFrame, seed: int) -> DataFrame:
    """The pairs (a, b) that link, on full sets. Cuts the lineage."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text_a", SLICE_BYTES):
                (row, value), (row_b, value_b) = (shingle_sets(*text_buffer(part.column(c)), seed) for c in ("text_a", "text_b"))
                row, value = np.concatenate([row, row_b]), np.concatenate([value, value_b])
                order = np.lexsort((value, row))
                row, value = row[order], value[order]
                same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
                both = np.bincount(row[1:][same], minlength=part.num_rows)
                n, m = (part.column(c).to_numpy() for c in ("n_a", "n_b"))
                yield part.select(["a", "b"]).filter(pa.array(similar(both, n, m, LEAST)))

    for end in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}")), end)
    pairs = pairs.where(100 * F.least("n_a", "n_b") >= LEAST * F.greatest("n_a", "n_b"))
    for end in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")), end)
    return cut(pairs.select("a", "b", "n_a", "n_b", "text_a", "text_b").mapInArrow(run, "a long, b long"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    with shuffles_dropped(docs.sparkSession):
        for seed in count():
            known = cut(facts(docs, seed))
            # Another seed, should two different sets share a node.
            clash = known.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("proof").alias("p"), F.max("proof").alias("q"))
            if clash.where("p != q").isEmpty():
                break
        members = groups_of(known)
        texts = texts_of(docs, known, members, seed)
        pairs = members.where("node != lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
        root = components(verified(pairs, texts, seed))
        rows = unsettled(members, root)
        if not rows.isEmpty():
            links = later_links(rows, texts, partial(shingle_sets, seed=seed), LEAST)
            root = moved_roots(root, components(links))
        named = known.select("doc_id", "n", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
        named = cut(named.select("doc_id", F.col("n").alias("n_shingles"), "root"))
    first = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    found = named.join(first.where("members > 1").drop("members"), "root", "left")
    found = found.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
