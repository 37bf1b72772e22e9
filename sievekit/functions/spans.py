"""Regex span extraction as Column expressions.

Native path (JVM, whole-stage friendly): ``regexp_extract_all`` gives the match
texts and ``split`` on the same pattern gives the gaps between them; start
offsets are the running sum of gap and match lengths, folded with
``aggregate``. ``length`` counts code points, so offsets equal Python's
``match.start()/end()``.

Python path (Arrow-batched ``pandas_udf`` with ``re.finditer``): for patterns
whose Java and Python meanings differ (lookarounds, Python-only syntax,
possible empty matches) and for patterns with pathological native cost.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sievekit.schema import SPANS

try:  # Python 3.11+
    import re._parser as _sre_parse  # type: ignore[import-not-found]
    import re._constants as _sre_c  # type: ignore[import-not-found]
except ImportError:  # pragma: no cover
    import sre_constants as _sre_c  # type: ignore[no-redef]
    import sre_parse as _sre_parse  # type: ignore[no-redef]


def java_flags(ignore_case: bool = False, dotall: bool = False) -> str:
    """Inline flags that make java.util.regex read a pattern as Python's ``re`` does.

    ``U``: Unicode ``\\d \\w \\s \\b`` (Python's default on str).
    ``d``: only ``\\n`` ends a line for ``.`` and ``$`` (as in Python).
    """
    flags = "dU"
    if ignore_case:
        flags += "iu"
    if dotall:
        flags += "s"
    return f"(?{flags})"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running_sum(values: Column) -> Column:
    """Inclusive prefix sums of a non-empty int array, in doubling steps: n log n work, no copy per element."""

    def double(sums: Column, k: Column) -> Column:
        return let(F.pow(F.lit(2), k).cast("int"), lambda back: F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - back), F.lit(0))))

    steps = F.ceil(F.log2(F.size(values))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), F.greatest(steps, F.lit(1)) - 1), values, double)


def native_spans(text: Column, java_pattern: str | Column) -> Column:
    """array<struct<start,end,text>> of all non-overlapping matches, left to right.

    ``java_pattern`` must not be able to match the empty string. Offsets are prefix
    sums over the lengths of gaps and matches in turn.
    """

    def spans(found: Column) -> Column:
        matches, gaps = found["matches"], found["gaps"]
        lengths = F.flatten(F.zip_with(matches, gaps, lambda m, g: F.when(m.isNull(), F.array().cast("array<int>")).otherwise(F.array(F.length(g), F.length(m)))))
        ends = F.filter(let(lengths, running_sum), lambda _, i: i % 2 == 1)
        return F.zip_with(matches, ends, lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("text")))

    pattern = java_pattern if isinstance(java_pattern, Column) else F.lit(java_pattern)
    found = F.struct(F.regexp_extract_all(text, pattern, 0).alias("matches"), F.split(text, pattern, -1).alias("gaps"))
    return let(found, lambda f: F.when(F.size(f["matches"]) > 0, spans(f)).otherwise(F.array().cast(SPANS)))


@lru_cache(maxsize=256)
def _compiled(pattern: str, flags: int):
    return re.compile(pattern, flags)


def _finditer_rows(texts: pd.Series, pattern: str, flags: int) -> pd.Series:
    rx = _compiled(pattern, flags)
    out = []
    for t in texts:
        if t is None:
            out.append([])
            continue
        out.append([{"start": m.start(), "end": m.end(), "text": t[m.start() : m.end()]} for m in rx.finditer(t)])
    return pd.Series(out, dtype=object)


def python_spans(text: Column, pattern: str, flags: int = 0) -> Column:
    """Python ``re.finditer`` spans in an Arrow-batched pandas UDF (exact reference semantics)."""
    _compiled(pattern, flags)  # fail on the driver for a bad pattern

    @pandas_udf(SPANS)
    def _spans(texts: pd.Series) -> pd.Series:
        return _finditer_rows(texts, pattern, flags)

    return _spans(text)


# --- choosing the path for a user pattern ---------------------------------

# What Python's classes mean, spelled out so that Java reads them alike.
_CATEGORY = {
    _sre_c.CATEGORY_DIGIT: r"\p{Nd}",
    _sre_c.CATEGORY_SPACE: r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}",
    _sre_c.CATEGORY_WORD: r"\p{L}\p{N}_",
}
_NOT_CATEGORY = {
    _sre_c.CATEGORY_NOT_DIGIT: _sre_c.CATEGORY_DIGIT,
    _sre_c.CATEGORY_NOT_SPACE: _sre_c.CATEGORY_SPACE,
    _sre_c.CATEGORY_NOT_WORD: _sre_c.CATEGORY_WORD,
}
_WORD = f"[{_CATEGORY[_sre_c.CATEGORY_WORD]}]"
_AT = {
    _sre_c.AT_BEGINNING: r"\A",
    _sre_c.AT_BEGINNING_STRING: r"\A",
    _sre_c.AT_END: r"(?=\n?\z)",
    _sre_c.AT_END_STRING: r"\z",
    _sre_c.AT_BOUNDARY: f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))",
    _sre_c.AT_NON_BOUNDARY: f"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))",
}
_ONE_CHARACTER = (_sre_c.LITERAL, _sre_c.NOT_LITERAL, _sre_c.ANY, _sre_c.IN)
# Java recurses for every round of a repeated group, so only short fixed repeats of groups run natively.
GROUP_ROUNDS = 64


class _NotNative(Exception):
    """The pattern needs Python."""


def _char(code: int) -> str:
    return f"\\x{{{code:x}}}"


def _class_item(op, value) -> str:
    if op is _sre_c.LITERAL:
        return _char(value)
    if op is _sre_c.RANGE:
        return f"{_char(value[0])}-{_char(value[1])}"
    if op is _sre_c.CATEGORY and value in _CATEGORY:
        return _CATEGORY[value]
    if op is _sre_c.CATEGORY and value in _NOT_CATEGORY:
        return f"[^{_CATEGORY[_NOT_CATEGORY[value]]}]"
    raise _NotNative


def _java(items, rounds: int, at: dict = _AT) -> str:
    """Java text of parsed Python items; ``rounds`` multiplies the repeats of enclosing groups,
    ``at`` has the spelling of places between characters."""
    out = []
    for op, value in items:
        if op is _sre_c.LITERAL:
            out.append(_char(value))
        elif op is _sre_c.NOT_LITERAL:
            out.append(f"[^{_char(value)}]")
        elif op is _sre_c.ANY:
            out.append(r"[^\n]")
        elif op is _sre_c.IN:
            negated = value[0][0] is _sre_c.NEGATE
            out.append(("[^" if negated else "[") + "".join(_class_item(*x) for x in value[negated:]) + "]")
        elif op in (_sre_c.MAX_REPEAT, _sre_c.MIN_REPEAT):
            least, most, sub = value
            single = len(sub) == 1 and sub[0][0] in _ONE_CHARACTER
            if not single and (most is _sre_c.MAXREPEAT or rounds * most > GROUP_ROUNDS):
                raise _NotNative
            body = _java(sub, rounds if single else rounds * max(1, most), at)
            bound = "" if most is _sre_c.MAXREPEAT else int(most)
            out.append(f"(?:{body}){{{int(least)},{bound}}}" + ("?" if op is _sre_c.MIN_REPEAT else ""))
            if single:
                out[-1] = out[-1].replace(f"(?:{body})", body, 1)
        elif op is _sre_c.SUBPATTERN and not value[1] and not value[2]:
            body = _java(value[3], rounds, at)
            out.append(f"({body})" if value[0] is not None else f"(?:{body})")
        elif op is _sre_c.BRANCH:
            out.append("(?:" + "|".join(_java(branch, rounds, at) for branch in value[1]) + ")")
        elif op is _sre_c.GROUPREF:
            out.append(f"(?:\\{value})")
        elif op is _sre_c.AT and value in at:
            out.append(at[value])
        else:
            raise _NotNative
    return "".join(out)


# Characters on which Java's own idea of a word may differ from Python's: marks, joiners, numbers that
# are no digits, symbols that count as letters, and connectors. Without them, its own boundary is the same and faster.
ODD = r"[^\x00-\x7f\p{L}\p{Nd}\p{Zs}\p{Pd}\p{Ps}\p{Pe}\p{Pi}\p{Pf}\p{Po}\p{Sm}\p{Sc}\p{Sk}]"
_OWN_AT = _AT | {_sre_c.AT_BOUNDARY: r"(?U:\b)", _sre_c.AT_NON_BOUNDARY: r"(?U:\B)"}


def to_java(pattern: str, ignore_case: bool = False, at: dict = _AT) -> str | None:
    """Java pattern with exactly Python's matches, written anew from the parsed pattern, or None.

    None for what Java reads otherwise or can't run safely: flags, named groups, lookarounds,
    atomic groups, long repeats of groups. Raises ``re.error`` for a pattern that Python can't compile.
    """
    compiled = re.compile(pattern)
    if compiled.flags != re.UNICODE or compiled.groupindex:
        return None
    try:
        java = _java(_sre_parse.parse(pattern), 1, at)
    except _NotNative:
        return None
    return ("(?iu)" if ignore_case else "") + java


def can_run_natively(pattern: str) -> bool:
    """Whether the pattern has a Java form and can't match the empty string (which the split needs)."""
    return to_java(pattern) is not None and _sre_parse.parse(pattern).getwidth()[0] > 0


def pattern_spans(text: Column, pattern: str) -> Column:
    """Spans of a Python-syntax pattern that has a Java form. Boundaries of words are spelled out only for
    texts on which Java's own might differ."""
    exact, own = to_java(pattern), to_java(pattern, at=_OWN_AT)
    return native_spans(text, exact if exact == own else F.when(text.rlike(ODD), F.lit(exact)).otherwise(F.lit(own)))


def regex_spans(text: Column, pattern: str) -> Column:
    """Spans of a Python-syntax pattern, native where that gives the same matches."""
    return pattern_spans(text, pattern) if can_run_natively(pattern) else python_spans(text, pattern)
