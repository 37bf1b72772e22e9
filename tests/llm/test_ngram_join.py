"""The n-gram join against brute force, and its pigeonhole guarantee set by set."""

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievekit.llm import ngram_join as N
from sievekit.llm.common import text_buffer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """doc_id -> (set size, least doc_id of its component), for distinct doc_ids."""
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
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def words(rng, n):
    return ["".join(rng.choices("abcdef", k=4)) for _ in range(n)]


def corpus(seed=3):
    """Originals, edits around the threshold, copies, a shared passage, short and odd texts."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    texts = [None, "", " \t\n", "One two", "one  TWO", "one two three", "É é é é é é", "x" * 30_000, " ".join(["same"] * 500)]
    for n in [*range(4, 13), 20, 40, 68, 70, 90, 150, 400]:
        base = words(rng, n)
        texts.append(" ".join(base))
        for edits in (1, 2, max(1, n // 45), max(1, n // 35), max(1, n // 30)):
            changed = list(base)
            for at in rng.sample(range(n), min(edits, n)):
                changed[at] = "new" + str(rng.random())
            texts.append("\n".join(changed))
            texts.append(" ".join(changed[: n - n // 9]))
        texts.append(" ".join(base).upper())
    for _ in range(40):
        own = words(rng, 50)
        texts.append(" ".join(own[:25] + passage + own[25:]))
    texts += [" ".join(words(random.Random(1), 80))] * 30
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(3 * i + 1, texts[k]) for i, k in enumerate(order)]


def test_join_equals_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, -1, "x") for i, t in rows], "doc_id long, text string, n int, node string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.join(docs).collect()}
    assert got == brute(rows)


def brute_links(rows):
    """Unordered pairs of documents that link, as positions in ``rows``."""
    sets = [shingles(t) for _, t in rows]
    pairs = [(i, j) for j in range(len(rows)) for i in range(j)]
    return [(i, j) for i, j in pairs if sets[i] & sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]


def family(seed=11, members=40):
    """Edits of one text, some linked directly and some only by way of others, and copies of them."""
    rng = random.Random(seed)
    base = words(rng, 120)
    texts = []
    for _ in range(members):
        changed = list(base)
        for at in rng.sample(range(len(base)), rng.choice([0, 1, 2, 3, 4])):
            changed[at] = "new" + str(rng.random())
        texts += [" ".join(changed)] * rng.choice([1, 1, 3])
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("block", [7, N.BLOCK_SETS])
def test_all_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(N, "BLOCK_SETS", block)
    rows = corpus() + [(100_000 + i, t) for i, t in family()]
    want = brute_links(rows)
    n_links = dict.fromkeys((i for i, _ in rows), 0)
    for pair in want:
        for end in pair:
            n_links[rows[end][0]] += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in N.join(docs).collect()}
    assert got == {i: (*v, n_links[i]) for i, v in brute(rows).items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in N.components(docs).collect()} == brute(rows)
    pairs, membership = N.links(docs)
    node = {r.doc_id: r.node for r in membership.collect()}
    found = [(r.a, r.b) for r in pairs.collect()]
    ends = [sorted((node[rows[i][0]], node[rows[j][0]])) for i, j in want]
    assert len(found) == len(set(found)) and set(found) == {(a, b) for a, b in ends if a != b}


def test_links_count_rows_of_a_repeated_doc_id(spark):
    text = " ".join(words(random.Random(6), 40))
    docs = spark.createDataFrame([(1, text), (1, text), (1, "some other words here now"), (2, text + " end")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_links) for r in N.join(docs).collect()) == [(1, 0), (1, 2), (1, 2), (2, 2)]


def test_representatives_keep_one_of_each_group(spark):
    text = " ".join(words(random.Random(5), 30))
    rows = [(2, text), (1, text + " more"), (7, "something else"), (7, "something else"), (9, None), (None, text), (8, "")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, root string")
    kept = sorted(((r.doc_id, r.text, r.root) for r in N.representatives(docs).collect()), key=str)
    assert kept == sorted([(1, text + " more", "s"), (7, "something else", "s"), (9, None, "s"), (None, text, "s"), (8, "", "s")], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert N.join(docs).collect() == []


def one_row(values):
    return np.zeros(len(values), np.int64), np.sort(np.array(list(values), np.uint64))


def kept_names(sides, cost):
    """Names that each side keeps, scheme by scheme, as ``allocated`` does."""
    out = []
    for _, name, scheme, spare in sides:
        kept = set()
        for k in range(4):
            mine = sorted((cost(x), x) for x in name[scheme == k].tolist())
            shared = [x for c, x in mine if c > 1]
            if len(mine):
                kept |= set(shared[: max(0, len(shared) - int(spare[scheme == k][0]))])
        out.append(kept)
    return out


@settings(max_examples=500, deadline=None)
@given(st.integers(1, 400), st.integers(0, 1 << 30), st.integers(0, 3))
def test_linked_sets_keep_a_common_signature_and_are_never_far_apart(n, seed, busy):
    rng = random.Random(seed)
    one = [rng.getrandbits(64) for _ in range(n)]
    # The most edits that keep a link, spread over removals and additions.
    removed = added = 0
    while True:
        cut, more = (removed + 1, added) if rng.random() < 0.5 else (removed, added + 1)
        if cut >= n or 100 * (n - cut) < 75 * (n + more):
            break
        removed, added = cut, more
    other = one[removed:] + [rng.getrandbits(64) for _ in range(added)]
    sides, bins = [], []
    for values in (one, other):
        row, value = one_row(values)
        sides.append(N.signatures_of(row, value, 1))
        bins.append((N.bins_of(row, value, 1)[0], len(values)))
    # Other documents, unknown here, make some names dear, in either set or in both.
    own = [set(s[1].tolist()) for s in sides]
    extra = {x: rng.choice([0, 0, 1, 5, 900][: busy + 2]) for x in sorted(own[0] | own[1])}
    kept = kept_names(sides, lambda x: (x in own[0]) + (x in own[1]) + extra[x])
    assert kept[0] & kept[1] or set(one) == set(other)
    assert not N.far_apart(*bins[0], *bins[1])


def test_sets_with_a_shared_passage_keep_no_common_signature():
    rng = random.Random(0)
    passage = [rng.getrandbits(64) for _ in range(60)]
    sets = [passage + [rng.getrandbits(64) for _ in range(500)] for _ in range(20)]
    sides = [N.signatures_of(*one_row(s), 1) for s in sets]
    own = [set(s[1].tolist()) for s in sides]
    kept = kept_names(sides, lambda x: sum(x in o for o in own))
    assert not any(kept)


@pytest.mark.parametrize("texts", [["a b c d e f", "A  b\tc d\ne F", "", "a", None, "é ü ß a b c"], ["x"], [None], ["a b c d e a b c d e a b c d e"]])
def test_shingle_counts(texts):
    import pyarrow as pa

    row, value = N.shingle_sets(*text_buffer(pa.array(texts, pa.string())))
    sets = [set(value[row == i].tolist()) for i in range(len(texts))]
    want = [shingles(t) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in want]
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert (sets[i] == sets[j]) == (want[i] == want[j])
