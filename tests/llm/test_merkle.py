"""The Merkle manifest against a plain tree, and the closed-form places against a plain walk."""

import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sievekit.llm import merkle as M

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return digest("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in M.FIELDS)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([digest(levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        first = i - i % 16
        yield level[first:i], level[i + 1 : first + 16]
        i //= 16


def brute(rows):
    sources = {}
    for row in rows:
        sources.setdefault(row["source"], []).append(row)
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        sources[source].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[source] = tree([leaf(r) for r in sources[source]])
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for at, source in enumerate(order):
        for i, row in enumerate(sources[source]):
            steps = [*path(trees[source], i), *path(top, at)]
            changed = dict(row)
            if row["doc_id"] is not None and row["text"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0:
                changed["text"] = row["text"].translate(LOWER)
            node = leaf(changed)
            for left, right in steps:
                node = digest([*left, node, *right])
            proof = digest(x for step in steps for side in step for x in side)
            root = top[-1][0]
            out.append((row["doc_id"], leaf(row), trees[source][-1][0], root, proof, node, node == root))
    return sorted(out, key=str)


def check(df):
    got = sorted((tuple(r) for r in M.verify(df).select(COLUMNS).collect()), key=str)
    assert got == brute([r.asDict() for r in df.select(*M.FIELDS).collect()])
    return got


def test_odd_rows(spark):
    rows = [
        (None, "No id", "en", "a", 5), (None, None, None, None, None), (3, "", "en", "a", 0), (7, "Same", "en", "b", 4),
        (7, "Same", "en", "b", 4), (7, "Other Text", "en", "b", 4), (1, "É Ü", "fr", None, 3), (2, "X" * 200_000, "de", "", 200_000),
        *[(i, f"Row {i}", "en", "many", i) for i in range(40)],
    ]
    got = check(spark.createDataFrame(rows, SCHEMA))
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_a_tree_of_several_pages(spark):
    """8,200 leaves are three pages, so their roots are a tier of their own."""
    ids = spark.range(8_250)
    source = F.when(F.col("id") < 8_200, "hot").when(F.col("id") < 8_249, F.concat(F.lit("s"), F.col("id") % 17))
    check(ids.select(F.col("id").alias("doc_id"), F.format_string("Text %d", "id").alias("text"), F.lit("en").alias("lang"), source.alias("source"), F.lit(1).cast("long").alias("n_chars")))


def test_one_leaf_and_none(spark):
    (only,) = check(spark.createDataFrame([(4, "a", "en", "x", 1)], SCHEMA))
    assert only[1] == only[2] == only[3] and only[4] == sha256(b"").hexdigest()
    assert M.verify(spark.createDataFrame([], SCHEMA)).count() == 0


def test_other_columns_and_names_that_clash(spark):
    df = spark.createDataFrame([(i, "T", "en", "s", 1, "x", 9, 8) for i in range(20)], SCHEMA + ", tree string, block long, nth long")
    check(df)


@pytest.mark.parametrize("entries", [1, 2, 15, 16, 17, 256, 257, 300, 4095, 4096])
def test_places(entries):
    """The closed form addresses each node where the builder appended it."""
    height = M.height_of(entries)
    builder = M.Builder(height)
    for i in range(entries):
        builder.add(str(i))
    log, want = builder.finish(), [[str(i) for i in range(entries)]]
    for _ in range(height):
        want.append([digest(want[-1][i : i + 16]) for i in range(0, len(want[-1]), 16)])
    assert len(log) == sum(map(len, want))
    for level, nodes in enumerate(want):
        assert [log[M.place_of(level, i, entries, height)] for i in range(len(nodes))] == nodes


def test_log_has_every_node_once(spark):
    df = spark.range(5_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    tiers, _ = M.append_log(df)
    pages = [tier.select("tree", "block", "total", "n", (F.length("log") / 32).cast("int").alias("nodes")).orderBy("block").collect() for tier in tiers]
    assert [[(p["n"], p["nodes"]) for p in tier] for tier in pages] == [[(4096, 4369), (904, 904 + 57 + 4 + 1)], [(2, 3)]]
