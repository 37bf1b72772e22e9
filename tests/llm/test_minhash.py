"""Circulant MinHash against brute force over all pairs, and the signature's own properties."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.llm import groups as G
from sievekit.llm import minhash as M
from sievekit.llm.common import text_buffer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string"


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(words, words[1:], strict=False)) or frozenset((w,) for w in words)


def brute(rows):
    """(doc_id, set size, component, kept) of rows with distinct doc_ids."""
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted((i, len(sets[i]), find(i), i == find(i)) for i in ids)


def words(rng, n):
    return ["".join(rng.choices("abcdef", k=4)) for _ in range(n)]


def edited(rng, base, edits):
    out = list(base)
    for at in rng.sample(range(len(base)), min(edits, len(base))):
        out[at] = "new" + str(rng.random())
    return " ".join(out)


def corpus(seed=3):
    rng = random.Random(seed)
    texts = [None, "", " \t\n", "One", "one", "ONE two", "one  two", "É é", "É É", "x" * 30_000, " ".join(["same"] * 500), "a b a b a b"]
    for n in (3, 4, 5, 6, 8, 11, 20, 40, 80, 200, 700):
        base = words(rng, n)
        texts += [" ".join(base), " ".join(base).upper(), *(edited(rng, base, e) for e in (1, 2, n // 20, n // 12, n // 10, n // 8))]
    # A family whose members are mostly not alike, but linked through others.
    base = words(rng, 150)
    texts += [edited(rng, base, rng.randint(3, 14)) for _ in range(60)]
    passage = words(rng, 40)
    texts += [" ".join(passage + words(rng, rng.randint(3, 12))) for _ in range(40)]
    chain = words(rng, 120)
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = chain[10:] + words(rng, 10)
    rng.shuffle(texts)
    return list(enumerate(texts))


def run(df):
    out = M.near_duplicates(df)
    assert out.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted(map(tuple, out.collect()))


@pytest.mark.parametrize("seed", [3, 11])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, 1, "k", 5) for i, t in rows], SCHEMA + ", node long, key string, bands int").repartition(6)
    assert run(df) == brute(rows)


def test_blocks_of_large_groups(spark, monkeypatch):
    monkeypatch.setattr(G, "MINOR_BLOCK", 3)
    monkeypatch.setattr(G, "BLOCK", 4)
    rows = corpus(5)
    assert run(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (5, "other words of it"), (9, "other words of it"), (None, "a b c d e f"), (None, "q r s"), (None, None), (2, None)]
    got = sorted(map(str, run_any(spark, rows)))
    want = [(5, 5, 5, True), (5, 5, 5, True), (5, 3, 5, True), (9, 3, 5, False), (None, 5, 5, False), (None, 2, None, True), (None, 0, None, True), (2, 0, 2, True)]
    assert got == sorted(map(str, want))


def run_any(spark, rows):
    return [tuple(r) for r in M.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()]


def test_empty_table(spark):
    assert run(spark.createDataFrame([], SCHEMA)) == []


def test_a_group_of_copies(spark):
    ids = spark.range(3_000)
    text = F.when(F.col("id") % 3 == 0, F.lit("the very same text for all")).otherwise(F.concat_ws(" ", F.lit("own"), F.col("id"), F.col("id") * 7))
    got = run(ids.select(F.col("id").alias("doc_id"), text.alias("text")))
    assert [r for r in got if r[0] % 3 == 0] == [(i, 5, 0, i == 0) for i in range(0, 3_000, 3)]
    assert all(r[2] == r[0] and r[3] for r in got if r[0] % 3)


def test_coordinates_estimate_similarity():
    """Equal coordinates of two sets come as often as their similarity says, by one shifted permutation."""
    rng = np.random.default_rng(1)
    for shared, own in ((900, 100), (500, 500), (100, 900)):
        equal = []
        for _ in range(30):
            value = rng.integers(0, 1 << 63, shared + 2 * own).astype(np.uint64)
            a, b = np.sort(value[: shared + own]), np.sort(np.concatenate([value[:shared], value[shared + own :]]))
            signature = M.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]))
            equal.append((signature[0] == signature[1]).mean())
        assert abs(np.mean(equal) - shared / (shared + 2 * own)) < 0.02


def test_shingle_sets():
    import pyarrow as pa

    texts = ["a b c", None, "A  b\nC", "", "z", "a b", "b a"]
    row, value = M.shingle_sets(*text_buffer(pa.array(texts)))
    sets = [frozenset(value[row == i].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [2, 0, 2, 0, 1, 1, 1]
    assert sets[0] == sets[2] and sets[5] < sets[0] and len(sets[4] | sets[5] | sets[6]) == 3
