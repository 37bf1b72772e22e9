"""Luhn checksum as a native higher-order expression (no UDF).

Only ASCII digits count; other characters are dropped first. Digits are read
from the right: odd positions add the digit, even positions add the digit sum
of twice the digit (``2d - 9`` when ``2d > 9``). Valid when the sum is 0 mod 10.
An empty digit string sums to 0 and is valid, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def luhn_checksum(s: Column) -> Column:
    digits = F.regexp_replace(s, "[^0-9]", "")
    chars = F.split(F.reverse(digits), "")

    def term(c, i):
        d = c.cast("int")
        doubled = d * 2
        return F.when(i % 2 == 0, d).otherwise(F.when(doubled > 9, doubled - 9).otherwise(doubled))

    terms = F.transform(F.filter(chars, lambda c: c != ""), term)
    return F.aggregate(terms, F.lit(0), lambda acc, x: acc + x) % 10


def is_luhn_valid(s: Column) -> Column:
    return luhn_checksum(s) == 0
