"""User patterns: the native path gives Python's spans, stays linear, and never risks the JVM's stack."""

import re
import time

import pytest
from pyspark.sql import functions as F

from sievekit.functions.spans import can_run_natively, native_spans, regex_spans, to_java

PATTERNS = [
    r"[a[b]x", r"(?a)\d+", r"\0x", r"\v", r"\w+", r"\W+", r"\b\w", r"\B.", r"\s+", r"[^\s]+", r"[\S\d]+", r"a.c", r"x$", r"^a", r"\Aa|b\Z", r"(a|b){2,5}c",
    r"(a)(b)?\1", r"(?:ab)+", r"(?:a|b)+", r"[]x]+", r"[^]x]", r"[a\-z]", r"\x41", r"é+", r"a{2}", r"a+?b", r"(?i)A", r"(?<=a)b", r"[\w.]+@", r"[&&a]", r"#+",
]
TEXTS = ["", "aab abc[x]bx\na", "éa‍b c d\x1ce", "AaAé٠²五 a\vb\x0bx", "ababab abc aac\n", "x\n", "a-z]&&##", "\U0001f600a\U0001f600 \x000x", "a" * 300 + "b"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_spans_equal_python(spark, pattern):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", regex_spans(F.col("t"), pattern).alias("s"))
    for r in df.collect():
        assert [(s["start"], s["end"], s["text"]) for s in r.s] == [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, TEXTS[r.i])]


def test_long_group_repeats_go_to_python(spark):
    assert not can_run_natively("(?:ab|c)+") and not can_run_natively("(?:ab){1,500}")
    assert can_run_natively("(?:ab){1,5}") and to_java("(?a)x") is None
    text = "ab" * 50_000
    for pattern in ("(?:ab|c)+", "(?:a|b)+"):
        row = spark.createDataFrame([(text,)], "t string").select(regex_spans(F.col("t"), pattern).alias("s")).first()
        assert [(s["start"], s["end"]) for s in row.s] == [(0, 100_000)]


def test_spans_are_about_linear_in_matches(spark):
    def took(n):
        df = spark.createDataFrame([("ab " * n,)], "t string").select(F.size(native_spans(F.col("t"), to_java(r"\w+"))).alias("n"))
        start = time.perf_counter()
        assert df.first().n == n
        return time.perf_counter() - start

    took(100)
    assert took(40_000) < 20 * max(took(4_000), 0.3)


def test_boundaries_of_words_on_odd_characters(spark):
    """Every kind of character beside a digit group, in texts that take either spelling of a boundary."""
    import sys
    import unicodedata

    kinds = {}
    for code in range(sys.maxunicode + 1):
        if not 0xD800 <= code <= 0xDFFF:
            kinds.setdefault(unicodedata.category(chr(code)), []).append(chr(code))
    chars = [c for many in kinds.values() for c in many[:: max(1, len(many) // 40)]]
    texts = [f"{c}123-45-6789{c} x{c}987-65-4321 {c}" for c in chars]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    pattern = r"\b\d{3}[- ]\d{2}[- ]\d{4}\b"
    # Java's tables may be of an older version of Unicode than Python's, so only characters of an old one are compared.
    got = {r["i"]: [(s["start"], s["end"]) for s in r["s"]] for r in df.select("i", regex_spans(F.col("t"), pattern).alias("s")).collect()}
    wrong = [(hex(ord(c)), unicodedata.category(c)) for i, c in enumerate(chars) if unicodedata.ucd_3_2_0.category(c) != "Cn" and got[i] != [m.span() for m in re.finditer(pattern, texts[i])]]
    assert wrong == []
