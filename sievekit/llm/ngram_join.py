"""N-gram Jaccard join: universe-partition pigeonhole, verified exactly.

A document's set holds the hashes of its distinct ``WIDTH``-word shingles. Two
documents link when 100 * intersection >= 75 * union. Then their sets differ in at
most H = (n + m) / 7 shingles.

Partition. The universe of hashes is cut into segments; how many depends on the size
band (sizes 4^c to 4^(c+1)), so that a segment holds one or two shingles of a set. If
two sets differ in H shingles, then of any H + 1 segments in which they are not both
empty, one holds the same shingles in both.

Allocation. A set names the contents of its non-empty segments, and pays for each what its
name costs: the number of sets that have it. It keeps the H + 1 cheapest, in the order of
(cost, name), the fewest that suffice. Of two linked sets, take the one whose dearest kept
name comes first: it keeps H + 1 segments, so one of them is equal in the other set, has the
same name and cost there, and is kept there as well. Names that only one set has cost least
and never leave the counting, so passages that many documents share bring no candidates as
long as a document has enough of its own.

Rest. A set with too few non-empty segments keeps all of them, and H + 1 of its single
shingles as well, which finds its links to others like it. Sets of up to five shingles differ
in at most one, and keep their whole set and its one-deletion neighbourhood; those of one or
two link with equal ones only, and need none. A set near the
lower end of its band also takes part in the band below, where smaller partners are.

Search. Equal sets become one node first. Nodes that emit a common signature are
candidates, but no group is expanded into pairs: each node is first verified against the
node of its groups that shares most with others. Groups whose other nodes are then all connected
are done. The others, those with a node in common as one cluster, go to tasks whole, with their
texts, and are settled there (see ``groups``).
That finds the components, and may leave out links between nodes already known to be in one.

Links. ``components`` ends there. ``join`` and ``links`` then compare every two nodes of each
component: no link leaves a component, so these are all links. A component is dealt into blocks
by a hash of the node, and every two blocks meet in a group of their own, so a large component
is spread over many tasks; only pairs that link, or their number for each node, come out.

Edge cases: null text, or text without words, has an empty set: no links, a component of
its own. Fewer words than ``WIDTH`` form one shingle. Repeated rows are equal sets. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import cut, likely_in, mix64, shuffles_dropped, sized, sliced, text_buffer
from sievekit.llm.components import components as components_of
from sievekit.llm.components import joined_roots, moved_roots, roots_of_forest
from sievekit.llm.groups import common_shingles, later_links, set_keys, unsettled

WIDTH = 5
LEAST = 75  # percent
SLICE_BYTES = 1 << 20
BAND_RATIO = 4
PER_SEGMENT = 1.6  # shingles of the largest set of a band in each segment, on average
REGION = 0.8  # the part of the universe whose segments are used: the same for all sets
TINY = 5  # sets up to this size differ from a linked one in one shingle at most
OWN, BELOW, SINGLE, WHOLE = range(4)  # schemes of a signature
ID_BYTES = 16  # of a node and a doc_id
LEAST_BINS, PER_BIN = 16, 2
BLOCK_SETS, BLOCK_SHINGLES = 512, 1 << 19  # of a component's block, about

_u = np.uint64
_BASE = _u(0xD1342543DE82EF95)
_INVERSE = _u(pow(0xD1342543DE82EF95, -1, 1 << 64))
_LETTER = mix64(np.arange(1, 257, dtype=_u) * _u(0x9E3779B97F4A7C15))
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLACE = mix64(np.arange(1, WIDTH + 1, dtype=_u)) | _u(1)
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, base: np.uint64, n: int) -> np.ndarray:
    """base^0 ... base^(n-1) modulo 2^64, kept between calls."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        out = np.full(max(n, SLICE_BYTES + (1 << 16)), base)
        out[0] = 1
        have = _powers[kind] = np.multiply.accumulate(out)
    return have[:n]


def _per_row(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Order by row, then by value."""
    order = np.argsort(values)
    group = rows[order]
    kind = np.uint16 if len(group) == 0 or group.max() < 1 << 16 else np.int64
    return order[np.argsort(group.astype(kind), kind="stable")]


def shingle_sets(data: np.ndarray, offsets: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of every text, ordered by row and hash."""
    n, empty = len(offsets) - 1, (np.zeros(0, np.int64), np.zeros(0, _u))
    if not len(data):
        return empty
    data = _LOWER.take(data)
    inside = ~_BLANK.take(data)
    head = inside.copy()
    head[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    head[edges] = inside[edges]
    start = np.flatnonzero(head)
    if not len(start):
        return empty
    tail = inside.copy()
    tail[:-1] &= ~inside[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    tail[ends] = inside[ends]
    end = np.flatnonzero(tail) + 1
    # Word hash: a polynomial of its bytes, from prefix sums.
    sums = np.zeros(len(data) + 1, _u)
    np.cumsum(_LETTER.take(data) * _power("up", _BASE, len(data)), out=sums[1:])
    word = (sums[end] - sums[start]) * _power("down", _INVERSE, len(data))[start]
    word = mix64(word ^ ((end - start).astype(_u) * _u(0xA24BAED4963EE407)) ^ _u(seed))
    row = np.searchsorted(offsets, start, side="right") - 1
    counts = np.bincount(row, minlength=n)
    first = np.cumsum(counts) - counts
    # Whole shingles start at words that have WIDTH - 1 words of the same text after them.
    nth = np.arange(len(word)) - first[row]
    at = np.flatnonzero(nth + WIDTH <= counts[row])
    value = np.zeros(len(at), _u)
    for k in range(WIDTH):
        value += word[at + k] * _PLACE[k]
    owner = row[at]
    brief = np.flatnonzero((counts > 0) & (counts < WIDTH))
    if len(brief):
        extra = counts[brief].astype(_u) * _u(0xC2B2AE3D27D4EB4F)
        for k in range(WIDTH - 1):
            has = counts[brief] > k
            extra[has] += word[first[brief][has] + k] * _PLACE[k]
        value, owner = np.concatenate([value, extra]), np.concatenate([owner, brief])
    value = mix64(value)
    order = _per_row(value, owner)
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], value[new]


def most_different(n: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
    """The most shingles in which a set of size n and a linked one can differ: over partners
    of any size, or over partners smaller than ``below``."""
    if below is not None:
        return (n + below - 1) // 7
    return (n + 4 * n // 3) // 7


def band_of(n: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(np.maximum(_bits(n), 1)).astype(np.int64) - 1) // 2


def _bits(n: np.ndarray) -> np.ndarray:
    """All bits up to the highest one of n."""
    n = n.astype(np.int64)
    for k in (1, 2, 4, 8, 16, 32):
        n |= n >> k
    return n


def segments_of(band: np.ndarray) -> np.ndarray:
    return np.ceil(float(BAND_RATIO) ** (band + 1) / PER_SEGMENT).astype(np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for part in sliced(batch, "text", SLICE_BYTES):
            yield part, *text_buffer(part.column("text"))


def facts(docs: DataFrame, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, n, node, proof, bins.

    ``node`` and ``proof`` are two independent keys of the set; ``bins`` counts its
    shingles by hash (see ``bins_of``).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _texts(batches):
            row, value = shingle_sets(data, offsets, seed)
            size = part.num_rows
            n = np.bincount(row, minlength=size)
            node, proof = (set_keys(row, value, size, k).view(np.int64) for k in (0, 1))
            columns = [part.column("doc_id"), pa.array(n), pa.array(node, mask=n == 0), pa.array(proof), pa.array(bins_of(row, value, size), pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "node", "proof", "bins"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, node long, proof long, bins binary")


def _first_met(node: np.ndarray, n: np.ndarray, met: set) -> np.ndarray:
    """Rows whose set this task has not met before; copies add nothing."""
    out = np.zeros(len(node), bool)
    for i, key in enumerate(node.tolist()):
        if n[i] and key not in met:
            met.add(key)
            out[i] = True
    return out


def _segments(row: np.ndarray, value: np.ndarray, band: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, name) of every non-empty segment of the region, and how many each row has.

    Hashes are cut into segments by their order, so a row's sorted shingles lie segment by segment.
    """
    segment = ((value >> _u(32)) * segments_of(band)[row].astype(_u)) >> _u(32)
    used = segment < (REGION * segments_of(band))[row]
    row, value, segment = row[used], value[used], segment[used]
    first = np.ones(len(row), bool)
    first[1:] = (row[1:] != row[:-1]) | (segment[1:] != segment[:-1])
    at = np.flatnonzero(first)
    owner = row[at]
    place = segment[at] * _u(0x9E3779B97F4A7C15) + band[owner].astype(_u)
    name = mix64(np.add.reduceat(mix64(value), at) + mix64(place)) if len(at) else np.zeros(0, _u)
    return owner, name, np.bincount(owner, minlength=size)


def signatures_of(row: np.ndarray, value: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, signature, scheme, spare) of sets given row by row in order.

    ``spare`` is how many signatures of that scheme the row can do without.
    """
    n = np.bincount(row, minlength=size)
    band = band_of(n)
    low = np.maximum(BAND_RATIO**band, TINY + 1)
    large = n > TINY
    # Partners in the band below, down to three quarters of the size.
    down = large & (3 * n <= 4 * (low - 1)) & (low - 1 > TINY)
    out, few = [], np.zeros(size, bool)
    for scheme, takes_part, at_band, need in (
        (OWN, large, band, most_different(n) + 1),
        (BELOW, down, band - 1, most_different(n, low) + 1),
    ):
        pick = takes_part[row]
        owner, name, count = _segments(row[pick], value[pick], at_band, size)
        out.append((owner, name, scheme, (count - need)[owner]))
        few |= takes_part & (count < need)
    pick = few[row]
    out.append((row[pick], mix64(value[pick] + _u(0x632BE59BD9B4E019)), SINGLE, (n - most_different(n) - 1)[row[pick]]))
    # Whole sets and one-deletion neighbourhoods, up to the size of the largest partner of a tiny set.
    tiny = (n > 2) & (n <= TINY + 1)
    if tiny.any():
        r, v = row[tiny[row]], mix64(value[tiny[row]])
        whole = np.zeros(size, _u)
        np.add.at(whole, r, v)
        owner = np.concatenate([np.flatnonzero(tiny), r])
        name = mix64(np.concatenate([whole[tiny], whole[r] - v]) + _u(0x85EBCA77C2B2AE63))
        out.append((owner, name, WHOLE, np.full(len(owner), -1)))
    rows, names, schemes, spares = zip(*out, strict=True)
    scheme = np.repeat(schemes, [len(r) for r in rows])
    return np.concatenate(rows), np.concatenate(names), scheme, np.concatenate(spares)


def signatures(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(sig, node, code) of every set that a task meets, once per task; code is 4 * spare + scheme."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set = set()
        for part, data, offsets in _texts(batches):
            row, value = shingle_sets(data, offsets, seed)
            node = set_keys(row, value, part.num_rows, 0)
            new = _first_met(node, np.bincount(row, minlength=part.num_rows), met)[row]
            owner, sig, scheme, spare = signatures_of(row[new], value[new], part.num_rows)
            code = (4 * spare + scheme).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(node[owner].view(np.int64)), pa.array(code)], ["sig", "node", "code"])

    return docs.select("text").mapInArrow(run, "sig long, node long, code int")


def allocated(found: DataFrame) -> DataFrame:
    """(sig, node, place, low) of the signatures that nodes keep and that several nodes share.

    ``place`` orders nodes by how much they share with others, the most first, and ``low`` is
    the first node of a group in that order: of a family of near copies, that which the others
    were made from, or one close to it.
    """
    group = Window.partitionBy("sig")
    several = F.min("node").over(group) != F.max("node").over(group)
    counted = found.withColumn("cost", F.count(F.lit(1)).over(group)).withColumn("several", several)
    counted = cut(counted.where("several").drop("several").distinct())
    mine, own = Window.partitionBy("node"), Window.partitionBy("node", F.pmod("code", F.lit(4)))
    ranked = counted.withColumn("place", -F.sum("cost").over(mine))
    ranked = ranked.withColumn("nth", F.row_number().over(own.orderBy("cost", "sig"))).withColumn("n_shared", F.count(F.lit(1)).over(own))
    kept = ranked.where(F.col("nth") <= F.col("n_shared") - F.floor(F.col("code") / 4)).select("sig", "node", "place").distinct()
    first = F.min(F.struct("place", "node")).over(group)["node"]
    return cut(kept.withColumn("low", first).withColumn("several", several).where("several").drop("several"))


def bins_of(row: np.ndarray, value: np.ndarray, size: int) -> list[bytes]:
    """For each row, shingles counted by the low bits of their hash, in about half as many bins
    as shingles (a power of two). Halves of a longer list add up to the shorter one."""
    n = np.bincount(row, minlength=size)
    width = np.maximum((_bits(n // PER_BIN) + 1) // 2 * 2, LEAST_BINS)
    start = np.concatenate([[0], np.cumsum(width)])
    at = start[row] + (value & (width[row] - 1).astype(_u)).astype(np.int64)
    counts = np.minimum(np.bincount(at, minlength=start[-1]), 255).astype(np.uint8)
    return [counts[i:j].tobytes() for i, j in zip(start[:-1].tolist(), start[1:].tolist(), strict=True)]


def far_apart(a: bytes, n: int, b: bytes, m: int) -> bool:
    """Whether sizes and bins alone show that two sets can't link.

    The bins' differences add up to no more than the sets differ by. A full bin stands for
    any number, so sets with one are not ruled out.
    """
    if 4 * min(n, m) < 3 * max(n, m):
        return True
    if b"\xff" in a or b"\xff" in b:
        return False
    x, y = np.frombuffer(a, np.uint8).astype(np.int16), np.frombuffer(b, np.uint8).astype(np.int16)
    if len(x) != len(y):
        width = min(len(x), len(y))
        x, y = x.reshape(-1, width).sum(0), y.reshape(-1, width).sum(0)
    return bool(7 * int(np.abs(x - y).sum()) > n + m)


def linked(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], pairs: int) -> np.ndarray:
    """Exact test of each pair of sets, given as (pair, hash) in any order."""
    row, value = np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]])
    order = _per_row(value, row)
    row, value = row[order], value[order]
    same = (row[1:] == row[:-1]) & (value[1:] == value[:-1])
    both = np.bincount(row[1:][same], minlength=pairs)
    union = np.bincount(row, minlength=pairs) - both
    return (union > 0) & (100 * both >= 75 * union)


def _beside(pairs: DataFrame, of: DataFrame, *values: str) -> DataFrame:
    """Pairs (a, b) with the values of both nodes."""
    for end in ("a", "b"):
        pairs = pairs.join(of.select(F.col("node").alias(end), *[F.col(v).alias(f"{v}_{end}") for v in values]), end)
    return pairs.select("a", "b", *[f"{v}_{end}" for v in values for end in ("a", "b")])


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) that sizes and bins don't rule out. ``nodes`` has (node, n, bins)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("bins_a", "n_a", "bins_b", "n_b")), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([not far_apart(*r) for r in rows], pa.bool_()))

    return cut(_beside(pairs, nodes, "n", "bins").mapInArrow(run, "a long, b long"))


def verified(pairs: DataFrame, texts: DataFrame, seed: int = 0) -> DataFrame:
    """The pairs that link, by comparing their sets. ``texts`` has (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, "text_a", SLICE_BYTES):
                a, b = (shingle_sets(*text_buffer(part.column(c)), seed) for c in ("text_a", "text_b"))
                yield part.select(["a", "b"]).filter(pa.array(linked(a, b, part.num_rows)))

    return cut(_beside(pairs, texts, "text").mapInArrow(run, "a long, b long"))


def ends_of(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs (a, b)."""
    return pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()


def texts_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """(node, text) of every wanted node."""

    def meant(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A repeated doc_id may bring texts of other sets.
        for part, data, offsets in _texts(batches):
            key = set_keys(*shingle_sets(data, offsets, seed), part.num_rows, 0).view(np.int64)
            yield part.select(["node", "text"]).filter(pa.array(part.column("node").to_numpy() == key))

    ids = cut(nodes.join(wanted, "node").select("doc_id", "node"))
    found = likely_in(docs.select("doc_id", "text"), ids, "doc_id").join(sized(ids, ID_BYTES), "doc_id").select("node", "text")
    return cut(found.mapInArrow(meant, "node long, text string").dropDuplicates(["node"]))


def separate(pairs: DataFrame, root: DataFrame) -> DataFrame:
    """The pairs whose nodes are not yet known to be in one component."""
    for end in ("a", "b"):
        pairs = pairs.join(root.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def clustered(rows: DataFrame) -> DataFrame:
    """(key, node, lead) of the nodes of unsettled groups, groups with a node in common taken as one; nothing leads."""
    first = rows.groupBy("key").agg(F.min("node").alias("a"))
    near = components_of(rows.join(first, "key").select("a", F.col("node").alias("b")).distinct())
    nodes = rows.select("node").distinct().join(near, "node", "left")
    return nodes.select(F.coalesce("root", "node").alias("key"), "node", F.lit(None).cast("long").alias("lead"))


def linked_sets(docs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(facts of every document, root of every node that is linked to a smaller one, seed of the hashes)."""
    for seed in range(1 << 16):
        known = cut(facts(docs, seed))
        sets = known.where(F.col("node").isNotNull())
        # Another seed, should two different sets share a node.
        clash = sets.groupBy("node").agg(F.min("proof").alias("p"), F.max("proof").alias("q")).where("p != q")
        if clash.isEmpty():
            break
    live = allocated(signatures(docs, seed))
    nodes = cut(
        sets.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("bins").alias("bins"))
        .join(live.select("node", "place").distinct(), "node")
    )
    # The first node of each group against all others; of these pairs, one of each node before the rest.
    near = possible(live.where("node != low").select(F.col("low").alias("a"), F.col("node").alias("b")).distinct(), nodes)
    texts = texts_of(docs, nodes, ends_of(near), seed)
    best = near.join(nodes.select(F.col("node").alias("a"), "place"), "a").groupBy("b").agg(F.min(F.struct("place", "a"))["a"].alias("a"))
    first = verified(best.select("a", "b"), texts, seed)
    forest = roots_of_forest(first)
    root = joined_roots(forest, verified(separate(near, forest), texts, seed))
    # What groups are still in several components meet in clusters, so a node goes out once however many groups it is in.
    rows = unsettled(live.select(F.col("sig").alias("key"), "node", F.col("low").alias("lead")), root)
    if not rows.isEmpty():
        rows = unsettled(clustered(rows), root)
        later = texts_of(docs, nodes, rows.select("node").distinct(), seed)
        root = moved_roots(root, components_of(later_links(rows, later, partial(shingle_sets, seed=seed), LEAST)))
    return known, root, seed


def _blocks(known: DataFrame, root: DataFrame) -> DataFrame:
    """(doc_id, node, root, copies, blocks) of every node of a component of several nodes."""
    family = root.select("node", "root").unionByName(root.select(F.col("root").alias("node"), "root").distinct())
    every = known.where(F.col("node").isNotNull()).groupBy("node")
    every = every.agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("copies"))
    members = cut(every.join(family, "node"))
    blocks = F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count(F.lit(1)) / BLOCK_SETS)).cast("int")
    return cut(members.join(members.groupBy("root").agg(blocks.alias("blocks")), "root").drop("n"))


def _all_links(docs: DataFrame, members: DataFrame, seed: int, counted: bool) -> DataFrame:
    """All links of nodes: as (a, b) with a < b, or if ``counted`` as parts of (node, linked), the
    number of documents of other sets that a node's documents link with."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _texts(batches):
            row, value = shingle_sets(data, offsets, seed)
            # A repeated doc_id may bring texts of other sets.
            meant = part.column("node").to_numpy() == set_keys(row, value, part.num_rows, 0).view(np.int64)
            at = np.searchsorted(row, np.arange(part.num_rows + 1)).tolist()
            column = pa.array([value[i:j].tobytes() for i, j in zip(at, at[1:], strict=False)], pa.binary())
            yield part.select(["node", "root", "copies", "blocks"]).append_column("set", column).filter(pa.array(meant))

    def compared(group: tuple, held: dict) -> pa.RecordBatch:
        _, low, high = group
        sides = [held.get(k, {}) for k in (low, high)]
        nodes = [np.array(list(side), np.int64) for side in sides]
        if not all(map(len, nodes)):
            link = np.zeros((len(nodes[0]), len(nodes[1])), bool)
        else:
            a, b = ([s for _, s in side.values()] for side in sides)
            both = common_shingles(a, b)
            union = np.array([len(s) for s in a])[:, None] + np.array([len(s) for s in b])[None, :] - both
            link = (both > 0) & (100 * both >= 75 * union)
            if low == high:
                link = np.triu(link, 1)
        if not counted:
            i, j = np.nonzero(link)
            ends = nodes[0][i], nodes[1][j]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(*ends)), pa.array(np.maximum(*ends))], ["a", "b"])
        copies = [np.array([c for c, _ in side.values()], np.int64) for side in sides]
        number = np.concatenate([link @ copies[1], link.T @ copies[0]])
        some = number > 0
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)[some]), pa.array(number[some])], ["node", "linked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("root", "low", "high", "block", "node", "copies", "set"))
            for *key, block, node, copies, values in zip(*columns, strict=True):
                if key != group:
                    if group is not None:
                        yield compared(group, held)
                    group, held = key, {}
                held.setdefault(block, {})[node] = (copies, np.frombuffer(values, _u))
        if group is not None:
            yield compared(group, held)

    found = likely_in(docs.select("doc_id", "text"), members, "doc_id").join(members, "doc_id").select("node", "root", "copies", "blocks", "text")
    found = found.mapInArrow(sets, "node long, root long, copies long, blocks int, set binary")
    found = found.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    found = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = found.select("root", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "copies", "set")
    met = found.repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    return met.mapInArrow(run, "node long, linked long" if counted else "a long, b long")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(every two distinct sets that link, as nodes a < b; the node of every document: doc_id, node).

    Documents of one node have equal sets and link as well. A document without words has no node.
    """
    with shuffles_dropped(docs.sparkSession):
        known, root, seed = linked_sets(docs)
        members = _blocks(known, root)
    return _all_links(docs, members, seed, False), known.select("doc_id", "node")


def join(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id of its component),
    n_links (the number of other documents it links with)."""
    with shuffles_dropped(docs.sparkSession):
        known, root, seed = linked_sets(docs)
        linked_to = cut(_all_links(docs, _blocks(known, root), seed, True).groupBy("node").agg(F.sum("linked").alias("linked")))
        every = known.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        every = every.join(root, "node", "left").withColumn("root", F.coalesce("root", "node")).join(linked_to, "node", "left")
        every = cut(every.select("node", "root", "least", (F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links")))
    named = every.join(every.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id", "n_links")
    named = known.select("doc_id", "n", "node").join(named, "node", "left")
    n_links = F.coalesce("n_links", F.lit(0)).alias("n_links")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), n_links)


def components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the least doc_id of its component).

    Looks at no more links than the components need.
    """
    with shuffles_dropped(docs.sparkSession):
        known, root, _ = linked_sets(docs)
    named = known.select("doc_id", "n", "node").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named.select("doc_id", F.col("n").alias("n_shingles"), "root"))
    first = named.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    shared = first.where("members > 1").drop("members")
    return named.join(shared, "root", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame) -> DataFrame:
    """One document of each group of linked ones, that of least doc_id, with all its columns.

    Rows of one doc_id are one document, of which the least row stays. Rows without a doc_id
    can't be named and all stay.
    """
    found = components(docs.select("doc_id", "text")).where(F.col("doc_id").isNotNull())
    is_first = F.max(F.col("doc_id") == F.col("component_id"))
    ids = cut(found.groupBy("doc_id").agg(is_first.alias("stays"), (F.count(F.lit(1)) > 1).alias("repeated")))
    apart = sized(cut(ids.where("repeated or not stays").select("doc_id")), ID_BYTES)
    near = likely_in(docs, apart, "doc_id").join(apart, "doc_id", "left_anti")
    kept = likely_in(docs, apart, "doc_id", "left_anti").select(*docs.columns).unionByName(near.select(*docs.columns))
    several = ids.where("repeated and stays").select("doc_id")
    if several.isEmpty():
        return kept
    least = docs.join(several, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return kept.select(*docs.columns).unionByName(least.select("row.*"))
