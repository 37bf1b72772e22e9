"""Vantage-point trees and connected components."""

import random

from collections import Counter

import numpy as np
import pytest

from sievekit.llm import ann, queries
from sievekit.llm.components import components, joined_roots, roots_of_forest

SF = "/root/testdata/sf0.01"


def brute(ids, vectors, q_ids, k):
    out = {}
    for q in q_ids:
        score = ann.exact_scores(np.repeat(vectors[ids == q][:1], len(ids), 0), vectors)
        ranked = sorted((-s, i) for s, i in zip(score.tolist(), ids.tolist(), strict=True) if i != q)
        out[q] = [(i, -s) for s, i in ranked[:k]]
    return out


@pytest.mark.parametrize("shape", ["random", "ties", "norms"])
def test_factor_one_is_exact(shape):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 8))
    if shape == "ties":
        v = np.repeat(v[:35], 20, axis=0)
    if shape == "norms":
        v *= rng.random((700, 1)) ** 4
    ids = rng.permutation(700) * 3
    tree = ann.VpTree.from_bytes(ann.VpTree(ids, v, float(np.linalg.norm(v, axis=1).max())).to_bytes())
    q = ids[:60]
    found, score = tree.search(q, v[:60], 5, 1.0)
    want = brute(ids, v, q.tolist(), 5)
    for row, i in enumerate(q.tolist()):
        assert list(zip(found[row].tolist(), score[row].tolist(), strict=True)) == want[i]


def test_a_larger_factor_visits_less():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(5000, 6))
    tree = ann.VpTree(np.arange(5000), v, float(np.linalg.norm(v, axis=1).max()))
    seen = []
    tree._scan = lambda rows, active, scan=tree._scan: (seen.append(len(rows) * len(active)), scan(rows, active))
    work = []
    for factor in (1.0, 1.5, 4.0):
        seen.clear()
        tree.search(np.arange(100), v[:100], 10, factor)
        work.append(sum(seen))
    assert 5000 * 100 > work[0] > work[1] > work[2]


def search(spark, rows, k=3, factor=1.0, every=1):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    good = ann.usable_vectors(df)
    index = ann.build_index(good, shard_rows=7).cache()
    return ann.search(index, good.where(f"vec_id % {every} = 0"), index.count(), k, factor) if index.count() else index


def test_search_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 4), 1.0], 0) for i in range(30)]
    bad = [(100, None, 0), (101, [0.0, 0.0], 0), (102, [1.0, None], 0), (103, [nan, 1.0], 0), (104, [inf, 1.0], 0), (105, [], 0), (106, [1.0], 0)]
    got = search(spark, rows + bad).collect()
    ids, v = np.arange(30), np.array([r[1] for r in rows])
    want = brute(ids, v, range(30), 3)
    assert {(r.query_id, r.rank): (r.vec_id, r.score) for r in got} == {(q, n + 1): w for q in want for n, w in enumerate(want[q])}
    two = search(spark, [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0)]).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(two)] == [(1, 1, 2), (2, 1, 1)]
    assert search(spark, bad[:6]).count() == 0 and search(spark, []).count() == 0


def test_search_query_recall(spark):
    got = queries.op7_vantage_point_trees(spark, SF).collect()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, v = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], np.float64)
    want = brute(ids, v, [i for i in ids.tolist() if i % 20 == 0], 20)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found.keys() == want.keys() and all(len(f) == 20 for f in found.values())
    hits = sum(len({i for i, _ in want[q]} & {i for i, _ in found[q]}) for q in want)
    assert hits / sum(map(len, want.values())) >= 0.9


def test_roots_of_a_forest_joined_by_links(spark):
    rng = random.Random(6)
    parents = [(rng.randrange(b), b) for b in range(1, 60)] + [(100, 101), (101, 102)] + [(200 + i, 201 + i) for i in range(20)]
    links = [(5, 102), (300, 301), (219, 59), (301, 300), (7, 7)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in parents + links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    forest = roots_of_forest(spark.createDataFrame(parents, "a long, b long"))
    got = {r.node: r.root for r in joined_roots(forest, spark.createDataFrame(links, "a long, b long")).collect()}
    by_root = {}
    for x in root:
        by_root.setdefault(got.get(x, x), set()).add(find(x))
    assert all(len(v) == 1 for v in by_root.values()) and len(by_root) == len({find(x) for x in root})


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(30)] + [(300, 200 + i) for i in range(50)] + [(7, 7), (500, 500)]
    rng.shuffle(edges)
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame(edges + edges[:20], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(df.limit(0)).count() == 0


def test_repeated_query_rows_get_a_list_each(spark):
    """Two equal rows of one vec_id, and one of it with another vector."""
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(60, 6)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(20, vectors[20].tolist()), (20, vectors[31].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build_index(df, 16).cache()
    got = ann.search(index, df.where("vec_id % 20 = 0"), index.count(), k=5, factor=1.0).collect()
    lists = sorted([r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 40])
    assert len(lists) == 5
    of_20 = [r for r in got if r.query_id == 20]
    assert sorted(r["rank"] for r in of_20) == sorted(list(range(1, 6)) * 3)

    def best(vector):
        scored = sorted(((-float(np.dot(vector, v)), i) for i, v in rows if i != 20))[:5]
        return [i for _, i in scored]

    want = Counter(i for v in (vectors[20], vectors[20], vectors[31]) for i in best(v))
    assert Counter(r.vec_id for r in of_20) == want
