"""Classifier post-processing: probabilities, answer labels, params fallbacks, token spans."""

import math

import pytest
from conftest import SMALL
from pyspark.sql import functions as F

from sievekit.operators import scores as S
from sievekit.plans.detect import detect
from sievekit.plans.dispatch import detect_per_row
from sievekit.plans.params import resolve_classifier_params
from sievekit.sources import scores as SS


def risk(spark, rows):
    df = spark.createDataFrame(rows, "content_id long, risk string, step int, token string, logprob double")
    return {r["content_id"]: r["prob_of_risk"] for r in S.token_logprob_risk(df).collect()}


def test_two_way_probability(spark):
    lp = math.log(0.5)
    got = risk(spark, [(1, "harm", 0, "Yes", lp), (1, "harm", 0, "No", lp), (2, "harm", 0, " yes ", math.log(0.9)), (3, "harm", 0, "maybe", 0.0)])
    assert got[1] == pytest.approx(0.5) and got[2] == pytest.approx(1.0) and got[3] == pytest.approx(0.5)


def test_topk_drops_last_step(spark):
    rows = [(1, "harm", s, f"t{k}", -float(k)) for s in range(3) for k in range(25)]
    df = spark.createDataFrame(rows, "content_id long, risk string, step int, token string, logprob double")
    top = S.topk_candidates(df).collect()
    assert len(top) == 2 * S.TOPK and max(r["step"] for r in top) == 1


@pytest.mark.parametrize("decoded,label", [("No", "No"), (" yes ", "Yes"), ("YES", "Yes"), ("maybe", "failed")])
def test_verdict_label(spark, decoded, label):
    df = spark.createDataFrame([(decoded,)], "d string")
    assert df.select(S.verdict_label(F.col("d"))).collect()[0][0] == label


def resolve(spark, params_json, **kw):
    df = spark.createDataFrame([(params_json,)], "p string")
    return df.select(resolve_classifier_params(F.col("p"), **kw).alias("r")).collect()[0]["r"]


@pytest.mark.parametrize("bad", ['"abc"', "-1", "0", "3.5", "true", "false", "[]", "{}"])
def test_bad_max_length_falls_back(spark, bad):
    assert resolve(spark, '{"max_length": %s}' % bad)["max_length"] == 512


@pytest.mark.parametrize("bad", ['"high"', "true", "[]", "{}", "null"])
def test_bad_threshold_falls_back(spark, bad):
    assert resolve(spark, '{"threshold": %s}' % bad)["threshold"] == 0.5


def test_threshold_outside_range_is_used(spark):
    assert resolve(spark, '{"threshold": 1.5}')["threshold"] == 1.5


def test_safe_labels(spark):
    assert resolve(spark, '{"safe_labels": "toxic"}')["safe_keys"] == ['"toxic"', "0"]
    assert resolve(spark, '{"safe_labels": [1, "insult", 3.14, true, ["x"]]}')["safe_keys"] == ['"insult"', "0", "1"]
    assert resolve(spark, '{"safe_labels": {"a": 1}}')["safe_keys"] == ["0"]


def test_label_thresholds_overlay(spark):
    r = resolve(spark, '{"label_thresholds": {"toxic": 0.2, "bad": "x"}}', default_label_thresholds={"obscene": 0.9, "toxic": 0.7})
    assert dict(r["label_thresholds"]) == {"obscene": 0.9, "toxic": 0.2}


def test_max_length_clamped(spark):
    assert resolve(spark, '{"max_length": 100000}', model_max_length=1024)["max_length"] == 1024
    assert resolve(spark, '{"max_length": 100000}', model_max_length=10**30)["max_length"] == 100000


LABELS = ["O", "B-PER", "I-PER", "B-LOC", "I-LOC"]


def plain_spans(text, tokens):
    """Runs by a plain loop over (token_idx, start, end, label, prob) in order."""
    runs = []
    for idx, start, end, label, prob in tokens:
        if runs and runs[-1]["label"] == label and runs[-1]["last"] + 1 == idx:
            runs[-1]["end"], runs[-1]["last"] = end, idx
            runs[-1]["probs"].append(prob)
        else:
            runs.append({"first": idx, "last": idx, "start": start, "end": end, "label": label, "probs": [prob]})
    return [(r["first"], r["start"], r["end"], text[r["start"] : r["end"]], r["label"], round(sum(r["probs"]) / len(r["probs"]), 9)) for r in runs]


def merged(spark, contents, **kw):
    """token_span_merge of {content_id: (text, tokens)} -> the same form as plain_spans."""
    tokens = [(c, *t) for c, (_, ts) in contents.items() for t in ts]
    best = spark.createDataFrame(tokens, "content_id long, token_idx int, char_start int, char_end int, label string, prob double").repartition(5)
    texts = spark.createDataFrame([(c, t) for c, (t, _) in contents.items()], "content_id long, text string")
    got = {c: [] for c in contents}
    for r in S.token_span_merge(best, texts, **kw).orderBy("content_id", "first_token").collect():
        got[r["content_id"]].append((r["first_token"], r["start"], r["end"], r["text"], r["detection_type"], round(r["score"], 9)))
    return got


def test_subword_tokens_cut_the_text_itself(spark):
    """Pieces of words, accents, an emoji and doubled blanks: the text is a slice, not a join of tokens."""
    text = "Ünal  Özdemir😀 lives in San\nFrancisco."
    pieces = ["Ün", "al", "Öz", "dem", "ir", "😀", "lives", "in", "San", "Fran", "cisco", "."]
    labels = ["B-PER"] * 6 + [None, None] + ["B-LOC"] * 3 + [None]
    tokens, at = [], 0
    for i, (piece, label) in enumerate(zip(pieces, labels, strict=True)):
        start = text.index(piece, at)
        at = start + len(piece)
        if label:
            tokens.append((i, start, at, label, 0.9))
    got = merged(spark, {1: (text, tokens)})[1]
    assert [g[3] for g in got] == ["Ünal  Özdemir😀", "San\nFrancisco"] and got == plain_spans(text, tokens)


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1024])
def test_runs_stitched_at_chunk_edges_equal_a_plain_loop(spark, chunk):
    import random

    rng = random.Random(chunk)
    contents = {}
    for c in range(12):
        text, tokens = "ab " * 60, []
        label = None
        for i in range(60):
            if rng.random() < 0.35:
                label = rng.choice([None, "A", "A", "B"])
            if label:
                tokens.append((i, 3 * i, 3 * i + 2, label, rng.random()))
        contents[c] = (text, tokens)
    contents[50] = ("x " * 40, [(i, 2 * i, 2 * i + 1, "A", 0.5) for i in range(40)])  # one run over many chunks
    assert merged(spark, contents, chunk=chunk) == {c: plain_spans(*v) for c, v in contents.items()}


def test_no_content_is_gathered(spark):
    best = spark.createDataFrame([(1, 0, 0, 2, "A", 0.5)], "content_id long, token_idx int, char_start int, char_end int, label string, prob double")
    plan = S.token_runs(best)._jdf.queryExecution().toString()
    assert "collect_list" not in plan


def test_best_label_in_the_row(spark):
    rows = [(1, [0.0, 1.0, 1.0, 0.0, -3.0]), (2, [9.0, 1.0, 0.0, 0.0, 0.0]), (3, [0.0, 0.0, 0.0, 5.0, 0.0])]
    df = spark.createDataFrame(rows, "id int, logits array<double>")
    limits = S.label_limits(LABELS, 0.1, {"B-LOC": 2.0}, S.safe_label_keys(["O", 4]))
    got = {r["id"]: r for r in S.best_labels(df, F.col("logits"), limits, LABELS).collect()}
    # A tie goes to the first label; the safe one wins no token; a limit over 1 is never met.
    assert got[1]["label"] == "B-PER" and got[1]["prob"] == pytest.approx(math.e / (2 * math.e + 2 + math.exp(-3)))
    assert set(got) == {1}


def test_best_label_equals_the_long_form(spark):
    rows = [(1, i, 1, 2, j, lab, float((i * 7 + j * 5) % 4)) for i in range(20) for j, lab in enumerate(LABELS)]
    long = spark.createDataFrame(rows, "content_id long, token_idx int, char_start int, char_end int, label_idx int, label string, logit double")
    want = S.token_best_label(S.softmax_long(long, ["content_id", "token_idx"]), 0.2, {"I-PER": 0.4}, S.safe_label_keys(["O"]))
    arrays = spark.createDataFrame([(i, [float((i * 7 + j * 5) % 4) for j in range(5)]) for i in range(20)], "token_idx int, logits array<double>")
    got = S.best_labels(arrays, F.col("logits"), S.label_limits(LABELS, 0.2, {"I-PER": 0.4}, S.safe_label_keys(["O"])), LABELS)
    assert {(r["token_idx"], r["label"], round(r["prob"], 9)) for r in want.collect()} == {(r["token_idx"], r["label"], round(r["prob"], 9)) for r in got.collect()}


def test_sequence_threshold_inclusive_and_safe(spark):
    df = spark.createDataFrame([(1, 0, "ok", 0.5), (1, 1, "toxic", 0.5), (1, 2, "spam", 0.7)], "content_id long, label_idx int, label string, prob double")
    out = S.sequence_classification(df, 0.5, {"spam": 0.8}, S.safe_label_keys([0]))
    assert [r["detection_type"] for r in out.collect()] == ["toxic"]


def test_greedy_decode_takes_lists_of_candidates(spark):
    rows = [(1, "harm", 1, -0.5, "o"), (1, "harm", 0, -2.0, "x"), (1, "harm", 0, -1.0, "N"), (1, "harm", 0, -1.0, "M"), (2, "harm", 0, -3.0, "Yes")]
    rows += [(1, "harm", 0, -0.9, "T")]
    flat = spark.createDataFrame(rows, "content_id long, risk string, step int, logprob double, token string")
    one = F.struct("logprob", "token")
    parts = [flat.where(c) for c in (F.col("token") != "T", F.col("token") == "T")]  # a step may be in several rows
    lists = [p.groupBy("content_id", "risk", "step").agg(F.collect_list(one).alias("candidates")) for p in parts]
    got = {tuple(r) for r in S.greedy_decode(lists[0].unionByName(lists[1])).collect()}
    assert got == {tuple(r) for r in S.greedy_decode(flat).collect()} == {(1, "harm", "To"), (2, "harm", "Yes")}


def test_candidate_lists_hold_the_candidates(spark):
    lists = SS.candidate_lists(spark, SMALL).select("content_id", "risk", "step", F.inline("candidates"))
    flat = SS.candidates(spark, SMALL).select("content_id", "risk", "step", "logprob", "token")
    assert lists.exceptAll(flat).count() == 0 == flat.exceptAll(lists).count()


def test_starts_of_null_and_empty_texts(spark):
    docs = spark.createDataFrame([(1, "é bb  c"), (2, None), (3, ""), (4, " a")], "content_id long, text string").repartition(1)
    got = sorted((r["content_id"], r["token_idx"], r["token"], r["char_start"], r["char_end"]) for r in SS.tokens(spark, SMALL, docs).collect())
    assert got == [(1, 0, "é", 0, 1), (1, 1, "bb", 2, 4), (1, 2, "", 5, 5), (1, 3, "c", 6, 7), (3, 0, "", 0, 0), (4, 0, "", 0, 0), (4, 1, "a", 1, 2)]


def test_texts_reach_python_in_bounded_batches(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    texts = spark.createDataFrame([(1, "a", '{"regex": "email"}')], "doc_id long, text string, detector_params string")
    plans = [lambda: detect(texts, {"file_type": ["yaml"]}), lambda: detect_per_row(texts, ["doc_id"]), lambda: SS.tokens(spark, SMALL)]
    before = spark.conf.get(key, None)
    try:
        for plan in plans:
            spark.conf.unset(key)
            plan()
            assert int(spark.conf.get(key).rstrip("b")) <= 8 << 20
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def test_tokens_are_labelled_once(spark):
    docs = spark.createDataFrame([(1, "a b")], "content_id long, text string")
    best = S.best_labels(SS.tokens(spark, SMALL, docs), SS.token_logits_array(F.col("token")), F.array(*[F.lit(0.5)] * 5), SS.TOKEN_LABELS)
    plan = best._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert sum("ArrowEvalPython" in line for line in plan) == 1 and sum("md5(" in line for line in plan) == 1


TEXTS = [
    (1, "Ünal  Özdemir😀 lives in San\nFrancisco ." * 3),
    (2, None),
    (3, ""),
    (4, " leading and trailing blanks  "),
    (5, "x" * 300 + " " + "é" * 27 + " " + "a" * 53 + " " + "b" * 54 + " end"),
    (6, " ".join(f"word{i % 37}" for i in range(3000))),
    (None, "no id at all"),
]


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "content_id long, text string").repartition(2)


def sorted_rows(df):
    return sorted(((*r[:-1], round(r["score"], 9)) for r in df.collect()), key=str)


def test_hashes_of_many_units_equal_hashlib():
    import hashlib
    import random

    import numpy as np

    rng = random.Random(1)
    units = [rng.randbytes(rng.choice([0, 1, 6, 50, 51, 52, 53, 54, 55, 56, 63, 64, 200])) for _ in range(500)]
    ends = np.cumsum([len(u) for u in units])
    starts = ends - [len(u) for u in units]
    for n in (5, 12):
        got = SS.md5_logits(np.frombuffer(b"".join(units), np.uint8), starts, ends, n)
        want = [[int(hashlib.md5(u + f"#{k}".encode()).hexdigest()[:4], 16) / 65535.0 * 8.0 - 4.0 for k in range(n)] for u in units]
        assert got.tolist() == want


def test_scores_of_a_content_are_those_of_its_tokens(spark):
    docs = docs_of(spark, TEXTS)
    long = SS.tokens(spark, SMALL, docs).select("content_id", "char_start", "char_end", SS.token_logits_array(F.col("token")).alias("l"))
    want = sorted(((r["content_id"], r["char_start"], r["char_end"], tuple(r["l"])) for r in long.collect()), key=str)
    got = []
    for r in SS.token_scores(spark, docs).collect():
        n = len(SS.TOKEN_LABELS)
        assert (r["starts"] is None) == (r["text"] is None)
        got += [(r["content_id"], s, e, tuple(r["logits"][n * i : n * i + n])) for i, (s, e) in enumerate(zip(r["starts"] or [], r["ends"] or [], strict=True))]
    assert sorted(got, key=str) == want


def test_a_content_in_one_row_has_the_spans_of_its_tokens(spark):
    """Without a shuffle, a sort or a walk through the text for each span."""
    docs = docs_of(spark, TEXTS)
    limits = S.label_limits(LABELS, 0.3, {"I-PER": 0.2}, S.safe_label_keys(["O"]))
    tok = SS.tokens(spark, SMALL, docs.withColumn("limits", limits)).where("NOT (char_start = 0 AND char_end = 0)")
    want = S.token_span_merge(S.best_labels(tok, SS.token_logits_array(F.col("token")), F.col("limits"), LABELS), docs)
    in_row = S.best_labels(SS.token_scores(spark, docs.withColumn("limits", limits)), F.col("logits"), F.col("limits"), LABELS)
    got = S.token_span_merge(in_row)
    assert got.dtypes == want.dtypes and sorted_rows(got) == sorted_rows(want) and got.count() > 1000
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and "Aggregate" not in plan and "substring(" not in plan
    assert sum("ArrowEvalPython" in line for line in plan.splitlines()) == 3


@pytest.mark.parametrize("query", ["token_span_merge", "token_classification"])
def test_documents_that_share_an_id_are_one_content(spark, tmp_path, query):
    from sievekit.plans import catalog_scores as C
    from sievekit.sources import requests as RQ

    rows = TEXTS + [(6, TEXTS[5][1]), (1, TEXTS[0][1]), (1, TEXTS[0][1])]
    docs_of(spark, rows).withColumnRenamed("content_id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    docs = C._documents(spark, str(tmp_path))
    params = (0.5, {}, S.safe_label_keys(["O"]))
    if query == "token_classification":
        docs = docs.withColumn("p", C._resolved_for("content_id", RQ.TOKEN_DEFAULTS))
        params = F.col("p.threshold"), F.col("p.label_thresholds"), F.col("p.safe_keys")
    want = S.token_span_merge(C._token_best(spark, str(tmp_path), *params, docs), docs).withColumn("score", F.round("score", C.R6))
    assert sorted_rows(C.build()[query][0](spark, str(tmp_path))) == sorted_rows(want)
