"""Fingerprints, chat windows and sampled pieces."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievekit.llm import chat, queries, sptokens
from sievekit.llm import fingerprint as fp

SF = "/root/testdata/sf0.001"

# Fingerprints


def joined(texts):
    return fp._joined([t.encode() for t in texts])


def phrases(text):
    """Set of (name, bytes) of all levels."""
    return {(n, c) for _, names, covered in fp.parse(*joined([text])) for n, c in zip(names.tolist(), covered.tolist(), strict=True)}


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(1, 8))) for _ in range(n))


def test_phrases_cover_the_text_on_every_level():
    text = prose(1, 300) + "é" * 50 + " " * 40
    levels = list(fp.parse(*joined([text])))
    assert all(covered.sum() == len(text.encode()) for _, _, covered in levels[1:]) and len(levels[-1][1]) == 1
    assert all(len(b[1]) < len(a[1]) for a, b in zip(levels[1:], levels[2:]))


def test_equal_substrings_share_interior_phrases_at_any_offset():
    shared = prose(2, 400)
    a, b = phrases(shared), phrases(prose(3, 37) + shared + prose(4, 11))
    long_ones = {x for x in a if x[1] >= 30}
    assert len(long_ones & b) >= 0.85 * len([x for x in long_ones if x[1] < len(shared) / 8])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab é\n", max_size=80), min_size=1, max_size=12))
def test_sketches_depend_on_the_text_alone(texts):
    together = fp.sketch_texts([t.encode() for t in texts])
    alone = np.vstack([fp.sketch_texts([t.encode()]) for t in texts])
    assert (together == alone).all()
    assert (fp.likeness(together, together) == 1).all()


def test_likeness_follows_the_shared_part():
    a, b = prose(5, 800), prose(6, 800)
    half = a[: len(a) // 2] + b[: len(a) // 2]
    s = fp.sketch_texts([t.encode() for t in (a, b, half, a + " end", "", "")])
    near = lambda i, j: float(fp.likeness(s[i : i + 1], s[j : j + 1])[0])
    assert near(0, 3) > 0.8 and 0.25 < near(0, 2) < 0.75 and near(0, 1) < 0.2
    assert near(4, 5) == 1 and near(0, 4) == 0
    assert (fp.from_hex(fp.to_hex(s)[0]) == s[0]).all()


def check_edits(rows, got):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] if r[0] is not None else 0), reverse=True)
    texts = [t or "" for _, t in order]
    assert len(got) == len(rows)
    want = {}
    for k, (i, _) in enumerate(order):
        a, b = texts[k], texts[(k + 1) % len(texts)]
        h = len(a) // 2
        want[i] = (len(a), hashlib.sha256((a[: len(a) - h] + b[:h]).encode()).hexdigest(), fp.to_hex(fp.sketch_texts([a.encode()]))[0])
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint) for r in got} == want
    for r in got:
        x, y = fp.from_hex(r.fingerprint)[None], fp.from_hex(r.edited_fingerprint)[None]
        assert r.near_edited == pytest.approx(float(fp.likeness(x, y)[0])) and 0 <= r.near_next <= 1


@pytest.mark.parametrize("buckets", [1, 2, 5, 40])
def test_edits_meet_the_next_document_across_buckets(spark, buckets):
    rows = [(i * 7 % 101, prose(i, i)) for i in range(60)] + [(200, None), (201, ""), (202, "é"), (None, "ab"), (500, "ñ" * 300_000)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fingerprint string").repartition(7)
    check_edits(rows, fp.compare_edits(docs, buckets).collect())


def test_edits_of_odd_tables(spark):
    schema = "doc_id long, text string"
    assert fp.compare_edits(spark.createDataFrame([], schema), 4).collect() == []
    one = fp.compare_edits(spark.createDataFrame([(3, "abcd")], schema), 4).collect()
    assert [(r.n_chars, r.edited_sha256) for r in one] == [(4, hashlib.sha256(b"abab").hexdigest())]
    same = fp.compare_edits(spark.createDataFrame([(3, "abcd")] * 5 + [(1, "xy")], schema), 4).collect()
    assert len(same) == 6 and len({r.fingerprint for r in same if r.doc_id == 3}) == 1


def test_fingerprint_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    check_edits(rows, queries.op10_consistent_parsing(spark, SF).collect())


# Chat windows

TEXT = st.text(alphabet=st.sampled_from("a <|\\>im_start\nend é"), max_size=40)


@given(st.lists(st.tuples(TEXT, TEXT), max_size=6))
def test_template_reads_back(turns):
    formatted = "".join(chat.format_turn(r, t) for r, t in turns)
    assert [(r, t) for r, t, _, _ in chat.read_back(formatted)] == turns


def conversation(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, window string")


def test_windows_keep_system_repeat_history_and_mask_repeats(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, k, "assistant" if k % 2 == 0 else "user", f"turn {k} " + "word " * 30) for k in range(1, 12)]
    got = [r.asDict() for r in chat.windows(conversation(spark, rows[::-1]), budget=110, history=1).orderBy("window").collect()]
    assert len(got) > 3 and sum(w["n_new"] for w in got) == 12
    at = 0
    for w in got:
        turns = chat.read_back(w["formatted"])
        assert (turns[0][0], turns[0][1]) == ("system", "be brief") and w["first_turn"] == at and w["n_tokens"] <= 110
        assert [t[1] for t in turns[len(turns) - w["n_new"] :]] == [r[3] for r in rows[at : at + w["n_new"]]]
        if w["window"]:
            assert turns[1][1] == rows[at - 1][3]
        at += w["n_new"]
        masked = [w["formatted"][s["start"] : s["end"]] for s in w["targets"]]
        assert masked == [t[1] for t in turns[len(turns) - w["n_new"] :] if t[0] == "assistant"]


def test_chat_budget_binds(spark):
    """A large system turn, long history, long words and sentences without blanks: no window is over
    the budget but for those that hold a system turn and one other alone."""
    rng = random.Random(6)
    sizes = [300, 40, 500, 400, 10, 700, 20, 20, 20, 250, 900, 5, 480, 30]
    rows = [(1, i, "system" if not i else ("user", "assistant")[i % 2], " ".join(rng.choices("abcd", k=n))) for i, n in enumerate(sizes)]
    rows += [(2, i, ("user", "assistant")[i % 2], rng.choice(["漢字" * 150, "x" * 1_200, "é" * 300])) for i in range(9)]
    for history in (0, 1, 4, 50):
        found = [r.asDict() for r in chat.windows(conversation(spark, rows), budget=1024, history=history).collect()]
        assert len(found) > 4
        for w in found:
            turns = chat.read_back(w["formatted"])
            assert w["n_tokens"] == chat.token_count(w["formatted"])
            assert w["n_tokens"] <= 1024 or (w["n_new"] == 1 and len(turns) <= 2)
    assert chat.token_count("漢字" * 150) == 300 and chat.token_count("x" * 10_000) == 2_500


def test_digests_equal_plain_ones(spark):
    probe = "<|im_end|><|im_start|>assistant ok"
    rows = [(c, k, ("user", "assistant", "system")[k % 3], f"{c} {k} " + "x y " * (k * 40)) for c in range(8) for k in range(c)]
    rows += [(20, 0, None, None), (20, 0, "assistant", ""), (21, None, "assistant", "a"), (21, 1, "assistant", "é" * 20_000), (-1, 0, "user", probe), (-1, 1, "assistant", probe)]
    rows += [(None, 0, "assistant", "lone"), (22, 0, "odd\nrole\\n<|", "b"), (23, 5, "assistant", "t"), (23, 5, "assistant", "t")]
    got = {r.conv_id: r for r in chat.digests(chat.windows(conversation(spark, rows))).collect()}
    by_conv = {}
    for c, k, role, text in rows:
        by_conv.setdefault(c, []).append((k is not None, k or 0, role or "", text or ""))
    assert got.keys() == by_conv.keys()
    for c, turns in by_conv.items():
        turns.sort()
        r, loss = got[c], "".join(t for _, _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, _, role, t in turns)
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.windows(conversation(spark, []).limit(0))).collect() == []


def test_chat_query(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = {r.conv_id: r.n_turns for r in queries.op9_budgeted_windows(spark, SF).collect()}
    assert sum(got.values()) == len(rows) + 2 and got[-1] == 2


# Sampled pieces


@pytest.fixture(scope="module")
def vocabulary():
    return sptokens.Vocabulary.from_model()


ODD = [None, "", " ", "  two  blanks ", "a", "naïve ▁ text\n\tof 汉字 and 😀 emoji", "\x00\x7f", "word " * 20_000, "汉" * 3000, "unbroken" * 1000, "a", "\u2581\u2581"]


def test_encoding_is_lossless_and_reproducible(spark, vocabulary):
    df = spark.createDataFrame([(i % 10, t, i) for i, t in enumerate(ODD)], "doc_id long, text string, ids int")
    out = sptokens.encode(df, vocabulary, F.col("doc_id")).cache()
    got = out.withColumn("back", sptokens.decode(F.col("ids"), spark, vocabulary)).collect()
    assert all(r.back == r.text for r in got) and len(got) == len(ODD)
    assert [r.ids for r in got if not r.text] == [None, []]
    again = sptokens.encode(df.repartition(5), vocabulary, F.col("doc_id")).collect()
    assert sorted(map(str, again)) == sorted(map(str, out.collect()))
    other = sptokens.encode(df, vocabulary, F.col("doc_id"), seed=7).collect()
    assert sorted(map(str, other)) != sorted(map(str, again))
    assert sptokens.encode(df.limit(0), vocabulary, F.col("doc_id")).collect() == []


def all_ways(vocabulary, text):
    """Every segmentation of a short text with its weight, by recursion."""
    usable = {p: (i, w) for i, (p, w) in enumerate(zip(vocabulary.pieces, vocabulary.log_weight, strict=True)) if w > -np.inf}
    ways = {0: {(): 1.0}}
    for end in range(1, len(text) + 1):
        ways[end] = {}
        for start in range(end):
            if text[start:end] in usable:
                i, w = usable[text[start:end]]
                for before, weight in ways[start].items():
                    ways[end][(*before, i)] = weight * np.exp(w)
    total = sum(ways[len(text)].values())
    return {k: v / total for k, v in ways[len(text)].items()}


def test_samples_follow_the_lattice_distribution(vocabulary):
    text, n = b" thinking", 20_000
    lattice = sptokens.Lattice(vocabulary)
    data, offsets = np.frombuffer(text * n, np.uint8), np.arange(n + 1) * len(text)
    ids, ends = lattice.sample(data, offsets, np.arange(n, dtype=np.uint64))
    seen = {}
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        way = tuple(ids[a:b].tolist())
        seen[way] = seen.get(way, 0) + 1
    want = all_ways(vocabulary, text)
    assert seen.keys() <= want.keys()
    for way, p in want.items():
        assert abs(seen.get(way, 0) / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 2e-4


def test_pieces_query_is_lossless(spark):
    got = queries.op6_sampled_pieces(spark, SF).collect()
    assert got and all(r.lossless and r.n_pieces == len(r.ids) for r in got)
