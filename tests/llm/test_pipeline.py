"""The pipeline, stage by stage, against plain versions of its decisions."""

import random
import re

import pytest

import corpus_pipeline as P
from sievekit.llm import mixing, sptokens
from test_ngram_join import brute, words
from test_native import fair_targets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string"


def rows():
    rng = random.Random(9)
    out = []
    for i in range(60):
        base = words(rng, 40 + i)
        out.append((10 * i, " ".join(base), "en" if i % 2 else "de", "hot" if i % 3 else None))
        if i % 4 == 0:
            out.append((10 * i + 1, " ".join(base) + " end", "en", "s1"))
        if i % 5 == 0:
            out.append((10 * i + 2, " ".join(base), None, "s2"))
    out += [(900, None, "en", "s1"), (901, "", "en", "s1"), (902, "123 456", "en", "s1"), (903, "card 4207051279108084 here", "en", "s2")]
    return [(*r, len(r[1] or ""), 1, "x") for r in out]


@pytest.fixture(scope="module")
def results(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.createDataFrame(rows(), SCHEMA).repartition(4)
    out = []
    for k, (_, stage) in enumerate(P.STAGES):
        stage(spark, docs, "").write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_return_the_columns_of_documents(results):
    assert all(df.columns == COLUMNS for df in results[:-1]) and len(results) == 5


def test_language_drops_texts_without_letters_only(results):
    assert texts(results[0]) == {r[0]: r[1] for r in rows() if r[1] and re.search("[a-z]", r[1])}


def test_one_document_of_each_group_stays(results):
    before = texts(results[0])
    want = {i for i, (_, first) in brute(list(before.items())).items() if i == first}
    assert texts(results[1]) == {i: before[i] for i in want}


def test_personal_data_goes_and_the_rest_stays(results):
    before, after = texts(results[1]), texts(results[2])
    assert before.keys() == after.keys()
    changed = {i for i in before if before[i] != after[i]}
    assert changed == {903} and "4207051279108084" not in after[903]
    assert all(r.n_chars == len(r.text) for r in results[2].collect())


def test_mix_follows_targets(results):
    before = [(r.source, len(r.text.split()), r.doc_id) for r in results[2].collect()]
    sizes = {}
    for s, n, _ in before:
        sizes[s] = sizes.get(s, 0) + n
    want = fair_targets(sizes)
    copies = {}
    for r in results[3].collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert max(copies.values()) <= mixing.MOST
    for s, target in want.items():
        got = sum(copies.get(i, 0) * n for x, n, i in before if x == s)
        assert abs(got - target) <= 2 * max(n for x, n, _ in before if x == s)


def test_pieces_decode_to_the_texts(spark, results):
    words = sptokens.Vocabulary.from_model()
    back = results[4].withColumn("text", sptokens.decode(results[4]["ids"], spark, words))
    assert sorted((r.doc_id, r.text) for r in back.collect()) == sorted((r.doc_id, r.text) for r in results[3].collect())


def test_empty_table_goes_through(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0


def test_language_drops_what_the_network_rejects(spark, results):
    junk = [(9000 + i, f"{k * 7919 % 10**9:09d} {k * 104729 % 16**8:08x} " * 12, None, "s1") for i, k in enumerate((3**15, 5**9, 7**8))]
    docs = spark.createDataFrame(rows() + [(*r, len(r[1]), 1, "x") for r in junk], SCHEMA)
    assert texts(P.language(spark, docs, "")) == texts(results[0])
