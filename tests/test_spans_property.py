"""Differential property test: native spans == Python re.finditer, and spans slice the text."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sievekit.functions.spans import can_run_natively, native_spans, to_java
from sievekit.operators import regex as RX

ALPHABET = "ab1234567890 -.@()+:xyzé😀\n\x1cA"
PATTERNS = [RX.EMAIL_PATTERN, RX.SSN_PATTERN, RX.US_PHONE_PATTERN, RX.UK_POST_CODE_PATTERN, r"[0-9]+", r"a+b?", r"\w+@\w+"]


def test_native_path_decisions():
    assert can_run_natively(r"[0-9]+")
    assert not can_run_natively(r"x*")  # can match empty
    assert not can_run_natively(r"(?<=a)b")  # lookbehind
    assert not can_run_natively(r"(?P<n>a)")  # Python-only syntax


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet=ALPHABET, max_size=40), min_size=1, max_size=20))
def test_native_equals_python(spark, texts):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    cols = [native_spans(F.col("t"), to_java(p)).alias(f"p{k}") for k, p in enumerate(PATTERNS)]
    rows = df.select("id", *cols).orderBy("id").collect()
    for r, t in zip(rows, texts):
        for k, p in enumerate(PATTERNS):
            exp = [(m.start(), m.end(), m.group(0)) for m in re.finditer(p, t)]
            got = [(s["start"], s["end"], s["text"]) for s in r[f"p{k}"]]
            assert got == exp, (p, t)
            for s, e, x in got:
                assert t[s:e] == x
