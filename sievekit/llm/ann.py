"""Approximate nearest neighbours by inner product: vantage-point trees per shard.

Inner product is not a metric, so every vector gets one more coordinate,
sqrt(M^2 - |x|^2) with M the largest norm, and a query gets 0 there. Euclidean
distance in that space falls as the inner product grows, and the triangle
inequality holds.

Rows are hashed into shards of about ``SHARD_ROWS``. Each shard builds one tree: a
node splits its rows at the median distance from a vantage point and keeps the
least and largest distance of either half. A search skips a half if its lower
bound, times ``factor``, exceeds the distance of the worst neighbour kept.
``factor`` 1 is exact; above 1 more is skipped. Queries are packed into blocks and
each block meets every shard, so both sides of a task are bounded; a shard's best
are merged by (score, vec_id).

Scores are plain double sums of the original components in order, the same for
equal vectors, so ties really tie and go to the smaller id.

Edge cases: vectors null, zero, of another length than most, or holding null or
non-finite components take no part; a repeated vec_id is as
many candidates and, as a query, as many queries with a list each; a query's own are all rows of its vec_id; with fewer than k candidates all are returned; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 20
FACTOR = 1.15
SHARD_ROWS = 8192
LEAF_ROWS = 128
BLOCK_QUERIES = 512
MOST_QUERIES = 1 << 31  # of a block, far from reached
SLACK = 1e-9  # rounding allowance of bounds, relative to M


def usable(vector: Column) -> Column:
    """Not null or empty, not all zero, every component a finite number."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))))
    return vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0)


class VpTree:
    """A vantage-point tree over the rows of one shard, as flat arrays.

    ``rows`` orders the vectors so that each node owns a slice. Node arrays: slice
    bounds, vantage point (a row), children and each half's distance bounds.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norm: float, seed: int = 7):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors, self.norm = ids[order], np.ascontiguousarray(vectors[order], np.float64), norm
        lift = np.sqrt(np.maximum(norm**2 - np.einsum("nd,nd->n", self.vectors, self.vectors), 0))
        self.lifted = np.hstack([self.vectors, lift[:, None]])
        self.rows = np.arange(len(ids))
        self.nodes: list[tuple] = []
        self.rng = np.random.default_rng(seed)
        if len(ids):
            self._split(0, len(ids))

    def _split(self, start: int, end: int) -> int:
        me = len(self.nodes)
        self.nodes.append((start, end, -1, -1, -1, 0.0, 0.0, 0.0, 0.0))
        if end - start <= LEAF_ROWS:
            return me
        own = self.rows[start:end]
        # Of a few tries, the vantage point whose distances spread most.
        tries = self.rng.choice(own, 4, replace=False)
        spread = [np.linalg.norm(self.lifted[own] - self.lifted[t], axis=1) for t in tries]
        best = int(np.argmax([np.std(d) for d in spread]))
        distance, vantage = spread[best], int(tries[best])
        near_first = np.argsort(distance, kind="stable")
        self.rows[start:end], distance = own[near_first], distance[near_first]
        half = (end - start) // 2
        bounds = (distance[0], distance[half - 1], distance[half], distance[-1])
        left, right = self._split(start, start + half), self._split(start + half, end)
        self.nodes[me] = (start, end, vantage, left, right, *map(float, bounds))
        return me

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores), each (queries, k), best first; missing ones have score -inf."""
        n = len(queries)
        self.q_ids, self.q, self.k, self.factor = query_ids, queries, k, factor
        self.q_lifted = np.hstack([queries, np.zeros((n, 1))])
        self.q_square = np.einsum("nd,nd->n", queries, queries)
        self.best_id = np.full((n, k), np.iinfo(np.int64).max)
        self.best = np.full((n, k), -np.inf)
        if self.nodes:
            self._visit(0, np.arange(n))
        return self.best_id, self.best

    def _worst(self, active: np.ndarray) -> np.ndarray:
        """Distance of the k-th neighbour so far, inf while there are fewer."""
        kth = self.best[active, -1]
        square = self.q_square[active] + self.norm**2 - 2 * kth
        return np.sqrt(np.maximum(square, 0)) + SLACK * self.norm

    def _visit(self, node: int, active: np.ndarray) -> None:
        start, end, vantage, left, right, *bounds = self.nodes[node]
        if vantage < 0:
            self._scan(self.rows[start:end], active)
            return
        d = np.linalg.norm(self.q_lifted[active] - self.lifted[vantage], axis=1)
        near = d < (bounds[1] + bounds[2]) / 2
        for inner_first in (True, False):
            mine = near if inner_first else ~near
            halves = ((left, bounds[0], bounds[1]), (right, bounds[2], bounds[3]))
            for child, low, high in halves if inner_first else halves[::-1]:
                rest, at = active[mine], d[mine]
                bound = np.maximum(np.maximum(at - high, low - at), 0)
                rest = rest[bound * self.factor <= self._worst(rest)]
                if len(rest):
                    self._visit(child, rest)

    def _scan(self, rows: np.ndarray, active: np.ndarray) -> None:
        rough = self.q[active] @ self.vectors[rows].T
        rough[self.q_ids[active][:, None] == self.ids[rows][None, :]] = -np.inf
        # Whoever may enter by rounding, or tie at the edge, is scored exactly below.
        who, what = np.nonzero(rough >= self.best[active, -1][:, None] - SLACK * self.norm**2)
        if not len(who):
            return
        who, what = active[who], rows[what]
        keep = self.q_ids[who] != self.ids[what]
        who, what = who[keep], what[keep]
        score = exact_scores(self.q[who], self.vectors[what])
        touched = np.unique(who)
        all_who = np.concatenate([who, np.repeat(touched, self.k)])
        all_id = np.concatenate([self.ids[what], self.best_id[touched].ravel()])
        all_score = np.concatenate([score, self.best[touched].ravel()])
        order = np.lexsort((all_id, -all_score, all_who))
        first = np.searchsorted(all_who[order], touched)
        pick = order[first[:, None] + np.arange(self.k)]
        self.best_id[touched], self.best[touched] = all_id[pick], all_score[pick]

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        nodes = np.array(self.nodes, np.float64).reshape(-1, 9)
        np.savez(out, ids=self.ids, vectors=self.vectors, norm=self.norm, rows=self.rows, nodes=nodes)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> VpTree:
        saved = np.load(io.BytesIO(data))
        self = cls.__new__(cls)
        self.ids, self.vectors, self.norm, self.rows = saved["ids"], saved["vectors"], float(saved["norm"]), saved["rows"]
        lift = np.sqrt(np.maximum(self.norm**2 - np.einsum("nd,nd->n", self.vectors, self.vectors), 0))
        self.lifted = np.hstack([self.vectors, lift[:, None]])
        self.nodes = [(*map(int, n[:5]), *n[5:].tolist()) for n in saved["nodes"]]
        return self


def exact_scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed in component order, so that equal rows give equal scores."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def build_index(vectors: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard: (shard, n_shards, tree). ``vectors`` has (vec_id, embedding), all usable."""
    facts = vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))).alias("norm"),
    ).first()
    n_shards, norm = max(1, -(-facts["n"] // shard_rows)), facts["norm"] or 0.0

    def build(key: tuple, rows: pa.Table) -> pa.Table:
        tree = VpTree(rows["vec_id"].to_numpy(), _matrix(rows["embedding"]), norm)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "n_shards": pa.array([n_shards], pa.int32()), "tree": pa.array([tree.to_bytes()], pa.binary())})

    spread = vectors.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n_shards)).cast("int").alias("shard"), "vec_id", "embedding")
    return spread.groupBy("shard").applyInArrow(build, "shard int, n_shards int, tree binary")


def query_blocks(queries: DataFrame, n_shards: int, block: int = BLOCK_QUERIES) -> DataFrame:
    """Packs (vec_id, embedding) into blocks and deals every block to every shard."""
    n_blocks = max(1, -(-queries.count() // block))

    def pack(key: tuple, rows: pa.Table) -> pa.Table:
        ids, matrix = rows["vec_id"].to_numpy(), _matrix(rows["embedding"])
        # The same order whenever the block is made, since a query is known by its place in it.
        order = np.lexsort((*matrix.T[::-1], ids))
        ids, matrix = ids[order], matrix[order]
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "query_ids": pa.array([ids.astype("<i8").tobytes()], pa.binary()), "query_vectors": pa.array([matrix.astype("<f8").tobytes()], pa.binary())})

    named = queries.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n_blocks)).alias("block"), "vec_id", "embedding")
    packed = named.groupBy("block").applyInArrow(pack, "block long, query_ids binary, query_vectors binary")
    return packed.select(F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"), "block", "query_ids", "query_vectors")


def search(index: DataFrame, queries: DataFrame, n_shards: int, k: int = K, factor: float = FACTOR) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[int, VpTree] = {}
        for batch in batches:
            for shard, tree, block, ids, flat in zip(*(batch.column(c).to_pylist() for c in ("shard", "tree", "block", "query_ids", "query_vectors")), strict=True):
                if shard not in trees:  # one tree is held at a time
                    trees = {shard: VpTree.from_bytes(tree)}
                q_ids = np.frombuffer(ids, "<i8")
                found, score = trees[shard].search(q_ids, np.frombuffer(flat, "<f8").reshape(len(q_ids), -1), k, factor)
                real = np.isfinite(score)
                at = block * MOST_QUERIES + np.arange(len(q_ids))
                columns = [np.repeat(q_ids, real.sum(1)), np.repeat(at, real.sum(1)), found[real], score[real]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "query", "vec_id", "score"])

    # Cut where the session limits rows of an Arrow batch: one pair of blobs at a time is enough.
    paired = query_blocks(queries, n_shards).join(index, "shard").select("shard", "tree", "block", "query_ids", "query_vectors")
    each = paired.mapInArrow(run, "query_id long, query long, vec_id long, score double")
    best = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return each.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable_vectors(table: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: usable, and of the commonest length."""
    good = table.select("vec_id", "embedding").where(usable(F.col("embedding")))
    length = good.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return good.where(F.size("embedding") == (length["n"] if length else 0))
