"""URL language models and language identification."""

import json
import random
import re
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievekit.llm import langid, queries, url_filter

SF = "/root/testdata/sf0.01"

# URL filter


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_for(host, path):
    fits = [r for r in url_filter.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = [
    None, "", "no scheme", "http://", "http://COM/", "https://WWW.Example.com/en/x?y#z", "https://example.com/en/", "https://example.com/en",
    "x://a.example.com/en/1", "http://net/es/", "http://a.net/fr/9?u=http://b.com/", "http://net?x", "http://É.net/de/", "http://a.b.org#t",
    "http://notcom/", "http://a.com", "ftp://x://y.com/p", "http://a.com\n/b", "http://" + "l" * 50_000 + ".org/" + "p" * 50_000, "http://a.net/fr/9?u=http://b.com/",
]


def test_rules_and_parts_follow_the_law(spark):
    pages = spark.createDataFrame([(i, u, "old", None) for i, u in enumerate(URLS)], "page_id long, url string, host string, rule string")
    got = url_filter.judge(pages, None).orderBy("page_id").collect()
    for r, url in zip(got, URLS, strict=True):
        rule = rule_for(*split_url(url))
        assert (r.host, r.path, r.rule) == (*split_url(url), rule and rule.text)
        assert r.verdict == ("allow" if rule is None or rule.allow else "block")


def test_url_query_agrees_with_rules(spark):
    got = queries.op1_url_language_models(spark, SF).collect()
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(urls)
    for r in got:
        rule = rule_for(*split_url(urls[r.page_id]))
        assert r.rule == (rule and rule.text) and r.verdict in ("allow", "block")
        if rule:
            assert r.verdict == ("allow" if rule.allow else "block")


def plain_log_prob(model, text):
    """Witten-Bell by dictionaries, character by character."""
    counts = []
    for gram, count, *_ in model.orders:
        counts.append({int(g): c for g, c in zip(gram, count, strict=True)})
    padded = bytes([url_filter.START]) * url_filter.ORDER + text
    total = 0.0
    for at in range(url_filter.ORDER, len(padded)):
        p = 1 / 256
        for k, (_, _, context, seen, kinds) in enumerate(model.orders):
            key = sum(padded[at - j] << (8 * j) for j in range(k + 1))
            where = np.flatnonzero(context == key >> 8)
            if len(where):
                n = counts[k].get(key, 0)
                p = (n + kinds[where[0]] * p) / (seen[where[0]] + kinds[where[0]])
        total += np.log(p)
    return total


def test_markov_scores_match_a_plain_version_and_tell_sides_apart():
    good = [f"site{i % 9}.org/news/{i}".encode() for i in range(200)]
    bad = [f"win-casino{i % 7}.biz/free?{i}".encode() for i in range(200)]
    model = url_filter.fit(good, bad)
    text = "site3.org/wiñ".encode()
    want = (plain_log_prob(model.accepted, text) - plain_log_prob(model.rejected, text)) / len(text)
    assert model.scores([text])[0] == pytest.approx(want)
    held = model.scores([b"site77.org/news/9999", b"casino1.biz/free?1", b""])
    assert held[0] > 0 > held[1] and held[2] == 0
    assert model.threshold <= 0
    assert url_filter.fit(good, []) is None


def test_probabilities_of_a_model_add_up():
    model = url_filter.MarkovModel([b"abcabcabd", b"abce"])
    total = sum(np.exp(plain_log_prob(model, b"ab" + bytes([c])) - plain_log_prob(model, b"ab")) for c in range(256))
    assert total == pytest.approx(1)


def test_the_models_see_the_whole_url(spark):
    rows = [f"https://site{i % 9}.com/news/{i}?page={i}#top" for i in range(300)] + [f"https://site{i % 9}.net/es/{i}?win=casino{i}#free" for i in range(300)]
    asked = ["https://a.org/news/1?page=2#top", "https://a.org/news/1?win=casino2#free", "win=casino7#free", "HTTP://A.ORG\n/x\n", None]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(asked + rows)], "page_id long, url string")
    got = url_filter.judge(pages, url_filter.fit_on_rules(pages)).orderBy("page_id").limit(len(asked)).collect()
    assert got[0].lm_score > got[1].lm_score and got[2].lm_score < 0 == got[4].lm_score
    assert [r.verdict for r in got[:3]] == ["allow", "block", "block"]
    whole = pages.select("page_id", url_filter.whole_of(F.col("url")).alias("w")).orderBy("page_id").limit(len(asked)).collect()
    assert [r.w for r in whole] == [*asked[:3], "HTTP://a.org\n/x\n", ""]


def test_url_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages, url_filter.fit_on_rules(pages)).count() == 0


# Language identification


def test_held_out_accuracy_and_score(spark):
    got = queries.op4_byte_convolutions(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert len(held) > 100 and np.mean(held) > 0.97


def toy_model():
    rng = np.random.default_rng(0)
    words = {"aa": ["the", "and", "thing", "ion"], "bb": ["ñe", "ció", "que", "ñó"]}
    texts, labels = [], []
    for lang, w in words.items():
        for _ in range(60):
            texts.append(" ".join(rng.choice(w, 40)).encode()[:256])
            labels.append(lang)
    return langid.train(texts, labels)


def test_prediction_edges(spark):
    model = toy_model()
    rows = [None, "", "123 !?", "the thing and the ion", "QUE ÑE CIÓ ÑÓ", "the and " * 30_000, "the", "the thing and the ion"]
    docs = spark.createDataFrame([(i, t, "old", 1) for i, t in enumerate(rows)], "doc_id long, text string, lang_pred string, score int")
    got = langid.predict(docs, model).orderBy("doc_id").collect()
    assert [r.lang_pred for r in got] == ["und", "und", "und", "aa", "bb", "aa", "aa", "aa"]
    assert [r.score for r in got[:3]] == [0, 0, 0] and got[3].score == got[7].score > 0.5
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_tables_by_code_equal_plain_convolution():
    model = toy_model()
    text = "the ñe 1".encode() * 40
    codes, _, held = langid.to_windows(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert held.sum() == len(text)
    emb, pooled = model.embedding[codes], []
    for w, f in zip(langid.WIDTHS, model.filters, strict=True):
        conv = sum(emb[:, k : langid.WINDOW - w + 1 + k] @ f[k] for k in range(w))
        pooled.append(conv.max(1))
    h = np.maximum(np.hstack(pooled) + model.bias, 0) @ model.weights + model.offset
    want = np.exp(h) / np.exp(h).sum(1, keepdims=True)
    assert np.allclose(model.probabilities(codes), want, atol=1e-4)


def test_the_sample_is_bounded_and_avoids_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    use = ~langid.held_out(F.col("doc_id"))
    rows = langid.labelled_windows(docs, use, docs_per_lang=20).collect()
    assert 0 < len(rows) < 4 * 2 * 40
    empty = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.fit(empty, use) is None
    assert json.dumps([list(r) for r in sorted(rows)]) == json.dumps([list(r) for r in sorted(langid.labelled_windows(docs.repartition(3), use, docs_per_lang=20).collect())])


def test_gradients_equal_small_differences():
    model = toy_model()
    model = replace(model, embedding=model.embedding.astype(np.float64), filters=[f.astype(np.float64) for f in model.filters])
    codes = langid.to_windows(np.frombuffer(("the ñe 1 and " * 60).encode(), np.uint8), np.array([0, 300, 840]))[0]
    target, weight = np.arange(len(codes)) % 2, np.linspace(1, 2, len(codes))

    def loss(learner):
        learner.model._tables = None
        p = learner.model.probabilities(codes)[np.arange(len(codes)), target]
        return -(np.log(p) * weight).sum() / weight.sum()

    learner = langid.Learner(model)
    gradients = learner.gradient(codes, target, weight)
    for p, g in zip(langid.parameters(learner.model), gradients, strict=True):
        assert p.shape == g.shape
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        kept, by = p[at], 3e-3
        p[at] = kept + by
        more = loss(learner)
        p[at] = kept - by
        less = loss(learner)
        p[at] = kept
        assert np.isclose((more - less) / (2 * by), g[at], rtol=0.1, atol=2e-3)
    before = loss(learner)
    for _ in range(30):
        learner.step(codes, target, weight)
    assert loss(learner) < before


def test_every_labelled_text_is_learned_and_calibrates(spark):
    """Texts beyond the sample change the network and the limit; their copies do not, nor do rows that are not in use."""
    words = {"aa": ["the", "and", "thing", "ion"], "bb": ["que", "nos", "cion", "del"]}
    rng = random.Random(3)
    rows = [(lang, " ".join(rng.choices(w, k=60)), True) for lang, w in words.items() for _ in range(40)]
    fit = lambda rows: langid.fit(spark.createDataFrame(rows, "lang string, text string, use boolean").coalesce(1), F.col("use"), docs_per_lang=6, reject=True)
    sample = lambda rows: sorted(map(tuple, langid.labelled_windows(spark.createDataFrame(rows, "lang string, text string, use boolean"), F.col("use"), 6).collect()))
    more = next(extra for i in range(99) if sample(rows + (extra := [("aa", f"{i} " + "0f3a9c 77e1b2 " * 30, True)])) == sample(rows))
    plain, other = fit(rows), fit(rows + more)
    assert not np.array_equal(plain.weights, other.weights) and other.limit > plain.limit
    again = fit(rows + rows[:9] + [("aa", "del que nos " * 30, False), (None, "del que " * 30, True)])
    assert all(np.allclose(a, b, atol=1e-6) for a, b in zip(langid.parameters(plain), langid.parameters(again), strict=True))


def test_junk_is_rejected_and_the_limit_decides(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    use = ~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()
    model = langid.fit(docs, use, reject=True)
    clean = docs.where(langid.held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    lost = lambda limit, of: langid.predict(of, replace(model, limit=limit)).where("lang_pred = 'und'").count()
    n = clean.count()
    assert lost(model.limit, clean) <= 0.02 * n and lost(1.0, clean) == 0 and lost(-1.0, clean) == n
    rng = np.random.default_rng(8)
    rows = [
        " ".join(map(str, rng.integers(0, 10**9, 40))) + " a", "".join(rng.choice(list("0123456789abcdef"), 300)),
        "x $%& ### ** !! " * 20, " ".join("".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(8)), "Привет мир, это текст о погоде и людях. " * 6,
    ]
    bad = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(bad, model).orderBy("doc_id").collect()] == ["und"] * len(rows)
    assert lost(1.0, bad) == 0


def test_copies_take_no_places_in_the_sample(spark):
    rows = [("xx", f"copied text {i % 4}") for i in range(560)] + [("xx", f"own text {i}") for i in range(40)] + [("yy", f"other {i}") for i in range(600)]
    rows += [("zz", "the only text")] * 500
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = [tuple(r) for r in langid.labelled_windows(docs, F.lit(True), docs_per_lang=30, windows=1).collect()]
    assert len(got) == len(set(got)) and {t for t, lang in got if lang == "zz"} == {"the only text"}
    assert [sum(lang == x for _, lang in got) for x in ("xx", "yy", "zz")] == [30, 30, 1]


def test_url_models_count_every_url_that_rules_decide(spark):
    rows = [(k, f"https://a{k % 7}.com/p{k * k}") for k in range(23_000)] + [(k, f"http://b{k % 5}.net/es/{k}x") for k in range(400)]
    known = spark.createDataFrame(rows, "page_id long, url string").repartition(5)
    model = url_filter.fit_on_rules(known)
    held = {r["url"] for r in known.where(F.pmod(F.xxhash64("url"), F.lit(url_filter.HELD_OUT)) == 0).collect()}
    urls = {u for _, u in rows}
    for side, mine in ((model.accepted, [u for u in urls if ".com/" in u]), (model.rejected, [u for u in urls if ".net/" in u])):
        want = url_filter.MarkovModel([u.encode() for u in mine if u not in held])
        for got, full in zip(side.orders, want.orders, strict=True):
            assert all((a == b).all() for a, b in zip(got[2:], full[2:], strict=True))  # contexts, totals, kinds
            assert set(zip(got[0], got[1])) <= set(zip(full[0], full[1]))
    scores = sorted(model.scores([u.encode() for u in held if ".com/" in u]))
    assert model.threshold == min(0.0, scores[max(0, -(-len(scores) // 100) - 1)]) and len(scores) > 4_000
