"""Collocations against plain counting of every phrase, in both forms of grams."""

import random
import re
from collections import Counter, defaultdict

import pytest

from sievekit.llm import collocations as C

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain_counts(rows):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, 6):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    return f, n


def brute(rows, least, first):
    f, n = plain_counts(rows)
    out = []
    for lang, counts in f.items():
        candidates = {p: c for p, c in counts.items() if len(p) > 1 and c >= least}
        scored = []
        for p, a in candidates.items():
            inside = any(len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in candidates.items())
            if not inside:
                score, _, l, r = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(scored)[:first], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def corpus():
    rng = random.Random(5)
    vocab = ["a", "b", "ab", "É", "zz", "of", "the", "x" * 5_000, "\x1c", "a\x1fb"]
    rows = [(None, "en"), ("", None), (" \t", "en"), (".,;", "en"), ("Null lang here", None), ("und is a lang", "und")]
    for i in range(60):
        words = rng.choices(vocab, k=rng.randint(1, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\r\n", "  ", "\x0b"]) for w in words)
        rows.append((text, rng.choice(["en", "de", None])))
    passage = "Of the people by the people for the people of the of the of the end"
    return rows + [(passage, "en")] * 7 + [(passage.upper() + "! " + passage, "de")] * 3


@pytest.mark.parametrize("most_codes", [C.CODES, 3])
@pytest.mark.parametrize("least", [1, 4])
def test_equals_brute_force(spark, most_codes, least):
    rows = corpus()
    df = spark.createDataFrame([(t, la, 7, "k") for t, la in rows], "text string, lang string, f long, words string").repartition(5)
    got = C.collocations(df, least, 40, most_codes)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == brute(rows, least, 40)


def test_flow_gives_the_count_of_every_phrase(spark):
    rows = corpus()
    phrases, vocab = C.frequent_phrases(spark.createDataFrame(rows, "text string, lang string"), 2)
    word = {r["key"]: (r["lang"], r["word"]) for r in vocab.collect()}
    got = {(word[r["words"][0]][0], tuple(word[k][1] for k in r["words"])): r["f"] for r in phrases.collect()}
    f, _ = plain_counts(rows)
    # A word may be in no phrase of its own count and still have one of one word.
    assert got == {(lang, p): c for lang, counts in f.items() for p, c in counts.items() if c >= 2}


def test_tasks_that_sum_in_parts(spark, monkeypatch):
    rows = [("a b c d e f. a b", "en")] * 120
    got = C.collocations(spark.createDataFrame(rows, "text string, lang string"))
    assert sorted(map(tuple, got.collect())) == brute(rows, 100, 2000)


def grams_counted(monkeypatch):
    """The numbers of grams that go into the counts from here on."""
    seen, counted = [], C.counted
    monkeypatch.setattr(C, "counted", lambda grams, *rest: seen.append(grams.count()) or counted(grams, *rest))
    return seen


def test_seldom_triples_of_frequent_pairs_are_not_counted(spark, monkeypatch):
    # 400 pairs occur about 25 times each, their 8,000 triples about once; one phrase occurs 20 times.
    rng = random.Random(8)
    rows = [(" ".join(rng.choices([f"w{k}" for k in range(20)], k=100)), "en") for _ in range(100)] + [("w1 w2 w3 w4 w5 w6", "en")] * 20
    seen = grams_counted(monkeypatch)
    got = C.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(4), 12)
    assert sorted(map(tuple, got.collect())) == brute(rows, 12, 2000)
    # At least the phrase's grams of three words and more in each of the tasks; before, nearly all 10,000 words.
    assert 4 <= seen[0] < 2_000


@pytest.mark.parametrize("least", [4, 300])
def test_grams_that_share_slots(spark, monkeypatch, least):
    # 2,048 slots hold more than one gram each, and 300 is more than a slot counts to.
    monkeypatch.setattr(C, "LEAST_SLOTS", 11)
    monkeypatch.setattr(C, "MOST_SLOTS", 11)
    rows = corpus() + [("the end of a and the end of the. the end", "en")] * 310
    got = C.collocations(spark.createDataFrame(rows, "text string, lang string").repartition(3), least)
    assert sorted(map(tuple, got.collect())) == brute(rows, least, 2000)


def test_products_beyond_64_bits(spark):
    row = spark.sql("SELECT (1000 * cast(9000000000000000 AS decimal(38,0)) * 9000000000000001L) div (cast(8999999999999999L AS decimal(38,0)) * 9000000000000000L) AS s").first()
    assert row["s"] == 1000 * 9000000000000000 * 9000000000000001 // (8999999999999999 * 9000000000000000)


def test_empty_tables(spark):
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).count() == 0
    assert C.collocations(spark.createDataFrame([(None, None), ("...", "en")], "text string, lang string")).count() == 0
