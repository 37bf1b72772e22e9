"""Links among nodes that share a group, on full sets, without pairs ever leaving a task.

Members of a group have met one of them, its lead. Where the others are then in several
components, the group goes to tasks whole, with its texts: members outside its largest component are
compared with those of all others, and only links that join two components come out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievekit.llm.common import cut, mix64, sliced, text_buffer

MINOR_BLOCK, BLOCK = 128, 512  # members of a group in a task, on either side
SLICE_BYTES = 1 << 20
COMPARED = 4096  # distinct shingles compared at once

_u = np.uint64


def set_keys(row: np.ndarray, value: np.ndarray, n: int, salt: int) -> np.ndarray:
    """A 64-bit key of each row's set, whatever its order."""
    out = np.zeros(n, _u)
    if len(row):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        out[row[first]] = mix64(np.add.reduceat(mix64(value ^ mix64(np.array([salt + 1], _u))[0]), first))
    return out


def similar(both: np.ndarray, n: np.ndarray, m: np.ndarray, least: int) -> np.ndarray:
    """Whether sets of sizes n and m with ``both`` shingles in common are ``least`` percent alike."""
    return (both > 0) & (100 * both >= least * (n + m - both))


def common_shingles(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``a`` has in common with each of ``b``."""
    out = np.zeros((len(a), len(b)), np.int64)
    both = np.intersect1d(np.concatenate(a), np.concatenate(b))
    if not len(both):
        return out
    sides = []
    for sets in (a, b):
        value, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(both, value), len(both) - 1)
        hit = both[at] == value
        order = np.argsort(at[hit], kind="stable")
        sides.append((at[hit][order], row[hit][order]))
    for first in range(0, len(both), COMPARED):
        marks = []
        for (at, row), sets in zip(sides, (a, b), strict=True):
            i, j = np.searchsorted(at, [first, first + COMPARED])
            mark = np.zeros((len(sets), COMPARED), np.float32)
            mark[row[i:j], at[i:j] - first] = 1
            marks.append(mark)
        out += (marks[0] @ marks[1].T).astype(np.int64)
    return out


def unsettled(members: DataFrame, root: DataFrame) -> DataFrame:
    """(key, node, root, minor, minors, others) of groups whose members, without the one all have been
    compared with, are in several components. ``members`` has (key, node, lead or null). ``minor`` marks
    members outside the largest component; ``minors`` and ``others`` are the blocks that either side
    is dealt into. Cuts the lineage."""
    rest = members.where("lead IS NULL OR node != lead").join(root, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    sizes = rest.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("key").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.max("n").alias("most"), F.sum("n").alias("n"))
    sizes = sizes.where("n > most").select(
        "key", "main", F.ceil((F.col("n") - F.col("most")) / MINOR_BLOCK).cast("int").alias("minors"), F.ceil(F.col("n") / BLOCK).cast("int").alias("others")
    )
    return cut(rest.join(sizes, "key").select("key", "node", "root", (F.col("root") != F.col("main")).alias("minor"), "minors", "others"))


def joined(group: list, other: list, least: int) -> Iterator[tuple[int, int]]:
    """Links between components, by their roots, between the minor members of a block and another
    block; members are (root, set). No link comes twice by way of those before it."""
    top: dict = {}

    def find(x: int) -> int:
        while (above := top.get(x, x)) != x:
            top[x] = x = top.get(above, above)
        return x

    roots = [np.array([r for r, _ in side], np.int64) for side in (group, other)]
    n, m = (np.array([len(s) for _, s in side], np.int64) for side in (group, other))
    apart = roots[0][:, None] != roots[1][None, :]
    low, high = np.minimum(n[:, None], m[None, :]), np.maximum(n[:, None], m[None, :])
    if not (apart & (100 * low >= least * high)).any():
        return
    both = common_shingles([s for _, s in group], [s for _, s in other])
    link = apart & similar(both, n[:, None], m[None, :], least)
    for i, j in zip(*(x.tolist() for x in np.nonzero(link)), strict=True):
        a, b = find(group[i][0]), find(other[j][0])
        if a != b:
            top[max(a, b)] = min(a, b)
            yield a, b


def later_links(rows: DataFrame, texts: DataFrame, shingles: Callable, least: int) -> DataFrame:
    """Links (a, b) between roots, found among the members of unsettled groups. ``texts`` has
    (node, text); ``shingles`` gives (row, hash) of a text buffer. Cuts the lineage."""

    def sets(part: pa.RecordBatch) -> list[np.ndarray]:
        row, value = shingles(*text_buffer(part.column("text")))
        return np.split(value, np.searchsorted(row, np.arange(1, part.num_rows)))

    def links(found: list) -> pa.RecordBatch:
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sides = None, ([], [])
        for batch in batches:
            found = []
            for part in sliced(batch, "text", SLICE_BYTES):
                columns = (part.column(c).to_pylist() for c in ("key", "low", "high", "side", "root"))
                for key, low, high, side, root, values in zip(*columns, sets(part), strict=True):
                    if (key, low, high) != now:
                        found += joined(*sides, least)
                        now, sides = (key, low, high), ([], [])
                    sides[side].append((root, values))
            yield links(found)
        yield links(list(joined(*sides, least)))

    def dealt(by: str, over: str, side: int) -> DataFrame:
        block = F.pmod(F.xxhash64("node"), F.col(by)).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col(over) - 1))
        low, high = (block, other) if side == 0 else (other, block)
        picked = rows.where("minor") if side == 0 else rows
        return picked.select("key", "node", "root", low.alias("low"), high.alias("high"), F.lit(side).alias("side"))

    met = dealt("minors", "others", 0).unionByName(dealt("others", "minors", 1)).join(texts.select("node", "text"), "node")
    met = met.select("key", "low", "high", "side", "root", "text").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return cut(met.mapInArrow(run, "a long, b long").distinct())
