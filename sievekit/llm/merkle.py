"""Merkle manifest of a table: a postorder append log, and proofs read from it.

Every row is a leaf, the sha256 of its fields. The leaves of a source, in order of doc_id, are the
bottom of a tree in which every ``ARITY`` consecutive nodes become one; its top is the source's
subroot. The subroots, in order of source, are the bottom of one more tree, whose top is the root.

Log. A tree is built in pages of ``PAGE`` entries, a power of ``ARITY``, so a page is a whole
subtree and no run crosses two pages. Its builder reads the entries in order and appends each node
when it is complete: the page's log is its subtree in postorder. The roots of a source's pages
are the entries of the next tier, until one page is left. A source with a third of all rows is
many pages, and no task holds more than one page.

Proofs. In postorder a node's place follows from sizes of subtrees alone (``place_of``), so a
leaf's siblings are addressed in the page's log without a search. A page gets the siblings of its
own root from the tier above, once for all its leaves.

Edge cases: a null field counts as ``-``; null doc_ids come first, and a row without one is not
tampered with; a null source is a source of its own, the first; repeated rows are leaves of their
own; a source of one leaf has that leaf as its subroot, and with one source its subroot is the root,
so the proof of a lone leaf is empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievekit.llm.common import ascii_lower, cut

ARITY = 16
PAGE = ARITY**3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPERED = 5  # rows with a checksum of doc_id divisible by it
HEX = 64


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(fields: dict[str, Column]) -> Column:
    """The digest of a row, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[_field(fields[f]) for f in FIELDS]), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, digest, tampered) of every row: the leaf, and the leaf of its text in lower
    case where the row is tampered with, else null. ``tree`` names the source."""
    fields = {f: F.col(f) for f in FIELDS}
    meant = F.crc32(F.col("doc_id").cast("string").cast("binary")) % TAMPERED == 0
    tree = F.coalesce(F.concat(F.lit("1"), F.col("source")), F.lit("0"))
    changed = leaf_of(fields | {"text": ascii_lower(F.col("text"))})
    return docs.select(tree.alias("tree"), "doc_id", leaf_of(fields).alias("digest"), F.when(meant, changed).alias("tampered"))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds nth (from 0) in the order of a tree, and the tree's total. Ranges of the order are
    counted first, so a large tree is numbered by many tasks. Cuts the lineage."""
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    dealt = cut(dealt.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()))
    parts = dealt.groupBy("tree", "part").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    by_part = Window.partitionBy("tree").orderBy("part")
    before = F.sum("n").over(by_part.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    parts = parts.withColumn("before", before).withColumn("total", F.sum("n").over(Window.partitionBy("tree")))
    found = dealt.join(parts.drop("n"), ["tree", "part"])
    return found.withColumn("nth", F.col("at") - F.col("first") + F.col("before")).drop("part", "at", "first", "before")


def height_of(total: int) -> int:
    """Levels above the entries of a page of a tree of ``total`` entries."""
    height, reach = 0, 1
    while reach < min(total, PAGE):
        height, reach = height + 1, reach * ARITY
    return height


def place_of(level: int, index: int, entries: int, height: int) -> int:
    """Where postorder puts a page's node: how many nodes are complete before it."""
    start = index * ARITY**level
    end = min(start + ARITY**level, entries)
    inside = sum(-(-end // ARITY**k) for k in range(level + 1))
    return inside - 1 + sum(start // ARITY**k for k in range(level + 1, height + 1))


def hashed(digests: list[str]) -> str:
    return sha256("".join(digests).encode()).hexdigest()


class Builder:
    """Appends the nodes of one page in the order of their completion."""

    def __init__(self, height: int) -> None:
        self.height, self.log, self.entries = height, [], 0
        self.open: list[list[str]] = [[] for _ in range(height + 1)]

    def add(self, digest: str, level: int = 0) -> None:
        self.entries += level == 0
        self.log.append(digest)
        self.open[level].append(digest)
        if len(self.open[level]) == ARITY and level < self.height:
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        self.add(hashed(run), level + 1)

    def finish(self) -> list[str]:
        for level in range(self.height):
            if self.open[level]:
                self._close(level)
        return self.log


def pages_of(entries: DataFrame, carried: list[str]) -> DataFrame:
    """One row for each page: tree, block, total, n, log (the nodes in postorder, 32 bytes each) and
    for each of ``carried`` the list of its entries' values."""
    rows = entries.withColumn("block", F.floor(F.col("nth") / PAGE).cast("long"))
    rows = rows.select("tree", "block", "nth", "total", "digest", *carried)
    kinds = dict(rows.dtypes)
    fields = {c: pa.list_(pa.int64() if kinds[c] == "bigint" else pa.binary()) for c in carried}
    schema = "tree string, block long, total long, n int, log binary"
    schema += "".join(f", {c} array<{kinds[c]}>" for c in carried)

    def page(key: tuple, builder: Builder, kept: list[list]) -> pa.RecordBatch:
        tree, block, total = key
        log = bytes.fromhex("".join(builder.finish()))
        columns = [pa.array([tree]), pa.array([block]), pa.array([total]), pa.array([builder.entries], pa.int32()), pa.array([log], pa.binary())]
        columns += [pa.array([values], kind) for values, kind in zip(kept, fields.values(), strict=True)]
        return pa.RecordBatch.from_arrays(columns, ["tree", "block", "total", "n", "log", *carried])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, builder, kept = None, None, []
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("tree", "block", "total", "digest", *carried))
            for tree, block, total, digest, *values in zip(*columns, strict=True):
                if (tree, block, total) != now:
                    if builder:
                        yield page(now, builder, kept)
                    now, builder, kept = (tree, block, total), Builder(height_of(total)), [[] for _ in carried]
                builder.add(digest.hex())
                for held, value in zip(kept, values, strict=True):
                    held.append(value)
        if builder:
            yield page(now, builder, kept)

    dealt = rows.repartition("tree", "block").sortWithinPartitions("tree", "block", "nth")
    return dealt.mapInArrow(run, schema)


def _root() -> Column:
    return F.expr("substring(log, length(log) - 31, 32)")


def tiers_of(entries: DataFrame, carried: list[str]) -> list[DataFrame]:
    """The pages of trees, tier by tier from the bottom, each cut. Trees of one page end there."""
    tiers = [cut(pages_of(entries, carried))]
    while True:
        above = tiers[-1].where(F.col("total") > PAGE)
        above = above.select("tree", F.col("block").alias("nth"), F.ceil(F.col("total") / PAGE).alias("total"), _root().alias("digest"))
        if above.isEmpty():
            return tiers
        tiers.append(cut(pages_of(above, [])))


def subroots_of(tiers: list[DataFrame]) -> DataFrame:
    """(tree, digest) of the top of every tree."""
    tops = [tier.where(F.col("total") <= PAGE).select("tree", _root().alias("digest")) for tier in tiers]
    out = tops[0]
    for top in tops[1:]:
        out = out.unionByName(top)
    return out


class Proofs:
    """Siblings in the log of one page, level by level from an entry to the page's root."""

    def __init__(self, log: bytes, entries: int, total: int) -> None:
        self.log, self.entries, self.height = log.hex(), entries, height_of(total)

    def node(self, level: int, index: int) -> str:
        at = place_of(level, index, self.entries, self.height) * HEX
        return self.log[at : at + HEX]

    def siblings(self, level: int, index: int) -> tuple[str, str]:
        """The run's nodes to the left of a node, and to its right."""
        first = index - index % ARITY
        last = min(first + ARITY, -(-self.entries // ARITY**level))
        left, right = (range(first, index), range(index + 1, last))
        return tuple("".join(self.node(level, i) for i in side) for side in (left, right))

    def paths(self) -> Iterator[list[tuple[str, str]]]:
        """For each entry in order, the siblings (left, right) of each level."""
        known: list[tuple[int, tuple[str, str]]] = [(-1, ("", ""))] * self.height
        for entry in range(self.entries):
            for level in range(self.height):
                index = entry // ARITY**level
                if known[level][0] != index:
                    known[level] = (index, self.siblings(level, index))
            yield [siblings for _, siblings in known]


_PATH = "path array<struct<left: string, right: string>>"


def _with_paths(pages: DataFrame, above: DataFrame | None) -> DataFrame:
    """Pages with the path of their root: (tree, block) is an entry (tree, nth) of the tier above."""
    if above is None:
        return pages.withColumn("path", F.expr("array()").cast("array<struct<left: string, right: string>>"))
    found = above.withColumnRenamed("nth", "block")
    return pages.join(found, ["tree", "block"], "left").withColumn("path", F.coalesce("path", F.expr("array()")))


def entry_paths(pages: DataFrame) -> DataFrame:
    """(tree, nth, path) of every entry of pages that have a path of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for batch in batches:
            for page in batch.to_pylist():
                found = [[{"left": x, "right": y} for x, y in path] + page["path"] for path in Proofs(page["log"], page["n"], page["total"]).paths()]
                nth = range(page["block"] * PAGE, page["block"] * PAGE + len(found))
                for i in range(0, len(found), 256):
                    part = found[i : i + 256]
                    yield pa.RecordBatch.from_arrays([pa.array([page["tree"]] * len(part)), pa.array(list(nth[i : i + 256]), pa.int64()), pa.array(part, kind)], ["tree", "nth", "path"])

    return pages.mapInArrow(run, f"tree string, nth long, {_PATH}")


def leaf_proofs(pages: DataFrame, root: str) -> DataFrame:
    """Of every leaf: doc_id, leaf, proof_sha256 and the root folded from the tampered leaf."""
    schema = "tree string, doc_id long, leaf string, proof_sha256 string, folded_root string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.to_pylist():
                above = [(step["left"], step["right"]) for step in page["path"]]
                rest = "".join(x + y for x, y in above)
                proofs, out = Proofs(page["log"], page["n"], page["total"]), []
                for entry, path in enumerate(proofs.paths()):
                    leaf, tampered = proofs.node(0, entry), page["tampered"][entry]
                    node = leaf if tampered is None else tampered.hex()
                    for left, right in (*path, *above):
                        node = hashed([left, node, right])
                    out.append((page["tree"], page["doc_id"][entry], leaf, hashed([*(x + y for x, y in path), rest]), node))
                columns = list(zip(*out, strict=True))
                kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()]
                arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["tree", "doc_id", "leaf", "proof_sha256", "folded_root"])

    found = pages.mapInArrow(run, schema).withColumn("root", F.lit(root))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def append_log(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The pages of the sources' trees and of the tree of their subroots, tier by tier from the
    bottom: (tree, block, total, n, log), with doc_id and tampered at the bottom."""
    tiers = tiers_of(numbered(leaves(docs), ["doc_id", "digest"]), ["doc_id", "tampered"])
    # Subroots in order of source: one tree for all, whose entries are the trees below.
    tops = subroots_of(tiers).select(F.lit("").alias("tree"), F.col("tree").alias("below"), "digest")
    entries = numbered(tops, ["below"])
    named = cut(entries.select("tree", "nth", "below", "digest", "total"))
    return tiers, [named, *tiers_of(named.select("tree", "nth", "total", "digest"), [])]


def verify(docs: DataFrame) -> DataFrame:
    """One row for each leaf: doc_id, leaf, subroot, root, proof_sha256 (all of the rows as they
    are), folded_root (from the tampered leaf, else the leaf, and the siblings) and verified."""
    tiers, (named, *upper) = append_log(docs)
    top = upper[-1].select(F.hex(_root())).first()
    root = (top[0] if top else "").lower()
    above = None
    for pages in reversed(upper):
        above = entry_paths(_with_paths(pages, above))
    # The path of a source's subroot is that of the root of its tree's last page.
    paths = cut(above.join(named.select("nth", "below", F.lower(F.hex("digest")).alias("subroot")), "nth").select(F.col("below").alias("tree"), "subroot", "path"))
    lower = None
    for pages in reversed(tiers):
        last = pages.where(F.col("total") <= PAGE).join(paths.select("tree", "path"), "tree")
        inner = None if lower is None else _with_paths(pages.where(F.col("total") > PAGE), lower)
        placed = last if inner is None else last.select(*inner.columns).unionByName(inner)
        if pages is tiers[0]:
            found = leaf_proofs(placed, root)
        else:
            lower = entry_paths(placed)
    found = found.join(paths.select("tree", "subroot"), "tree")
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
