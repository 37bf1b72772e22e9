"""Personal data: format-preserving Feistel pseudonyms, in DataFrame functions only.

Numbers, dates and addresses are found by one pattern and checked (Luhn, calendar,
number plan, octets). A value that holds is turned into a few units, each with its own
modulus: the free digits of a card, area, exchange and line of a phone, the octets of
an address, the day count of a date. A keyed Feistel network permutes the units: the
halves take turns, and each unit of one half is shifted, modulo its modulus, by a keyed
hash of the other half. That is a permutation of all values of the format, so a
pseudonym is again a valid value of the same format, equal values get equal pseudonyms
in all documents, unequal ones stay unequal, and whoever holds the key can undo it.

Kinds: ``email`` (letters and digits of the local part; of the domain as well, without
its last label, if the local part is short), ``card`` (13 to 19 digits with a right check
digit; the first digit stays, the check digit is made anew), ``ssn``, ``phone`` (North
American, or + and 8 to 15 digits, whose first two stay), ``ipv4``, ``date`` (from
1700-03-01, 400 years; year-month-day, day.month.year, month/day/year, or day/month/year if the
day is above 12; a time may follow after a T, and stays). Separators stay.

Left in clear text: dates with the name of a month or a year of two digits, and account numbers
(IBAN).

Edge cases: null text stays null and empty text empty; values that fail their check stay;
texts of any length are treated whole; repeated rows get equal results; other columns are
carried along, and ``text``, ``pii_kinds`` and ``pii_count`` are replaced or added.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KEY = "set a key of your own"

# Java patterns. Repeats are possessive or bounded, so that long texts cost linear time and no stack.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}+\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9-])"
IPV4 = r"(?<![\w.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"
CARD = r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\w-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?!\w)"
ABROAD = r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\w)"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?!(?!T\d\d)[\w/-]|\.\d)"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, IPV4, CARD, SSN, PHONE, ABROAD, DATE))
HINT = "[0-9@]"

FIRST_DAY = "1700-03-01"
DAY_UNITS = (27, 5411)  # their product is the days of 400 years
LATE_UNITS = (9, 9833)  # of those, the days after the twelfth of a month
SSN_UNITS = (898, 99, 9999)  # areas 001 to 899 without 666, groups, serials
PHONE_UNITS = (8, 10, 10, 8, 10, 10, 10, 10, 10, 10)
SHORT_LOCAL = 4


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once and named, so that the plan stays small."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _ints(values: tuple[int, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def feistel(values: Column, moduli: Column, tweak: Column, key: str, rounds: int = ROUNDS, undo: bool = False) -> Column:
    """Permutes an array of units, each below its modulus; ``undo`` gives the inverse."""
    sign = -1 if undo else 1
    order = range(rounds, 0, -1) if undo else range(1, rounds + 1)

    def keyed(turn: Column, other: Column, i: Column) -> Column:
        seen = F.concat_ws(",", F.transform(other, lambda u: u.cast("string")))
        block = F.sha2(F.concat_ws("|", F.lit(key), tweak, turn.cast("string"), F.floor(i / 8).cast("string"), seen), 256)
        return F.conv(F.substring(block, F.pmod(i, F.lit(8)) * 8 + 1, F.lit(8)), 16, 10).cast("long")

    def turned(mine: Column, limits: Column, other: Column, turn: Column) -> Column:
        return F.transform(mine, lambda v, i: F.pmod(v + sign * keyed(turn, other, i), F.get(limits, i).cast("long")).cast("int"))

    def network(parts: Column) -> Column:
        def step(state: Column, turn: Column) -> Column:
            odd = turn % 2 == 1
            return F.struct(
                F.when(odd, turned(state["left"], parts["left_limits"], state["right"], turn)).otherwise(state["left"]).alias("left"),
                F.when(odd, state["right"]).otherwise(turned(state["right"], parts["right_limits"], state["left"], turn)).alias("right"),
            )

        start = F.struct(parts["left"].alias("left"), parts["right"].alias("right"))
        return F.aggregate(_ints(tuple(order)), start, step, lambda end: F.concat(end["left"], end["right"]))

    half = F.ceil(F.size(values) / 2).cast("int")
    rest = F.size(values) - half
    halves = [
        F.slice(values, 1, half).alias("left"), F.slice(values, half + 1, rest).alias("right"),
        F.slice(moduli, 1, half).alias("left_limits"), F.slice(moduli, half + 1, rest).alias("right_limits"),
    ]
    return _let(F.struct(*halves), network)


def _digits(value: Column) -> Column:
    """Digits of a string as integers."""
    return F.transform(F.regexp_extract_all(value, F.lit(r"\d"), F.lit(0)), lambda d: d.cast("int"))


def _chars(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0))


def _written(digits: Column, pattern: Column) -> Column:
    """``pattern`` with its digits replaced, one after the other; all else stays."""

    def write(put: Column) -> Column:
        def add(state: Column, char: Column) -> Column:
            is_digit = char.rlike("[0-9]")
            new = F.when(is_digit, F.get(put, state["used"]).cast("string")).otherwise(char)
            return F.struct(F.concat(state["done"], new).alias("done"), (state["used"] + is_digit.cast("int")).alias("used"))

        return F.aggregate(_chars(pattern), F.struct(F.lit("").alias("done"), F.lit(0).alias("used")), add, lambda end: end["done"])

    return _let(digits, write)


def _padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")


def _tens(n: int | Column) -> Column:
    return F.array_repeat(F.lit(10), n)


def _units(holds: Column, kind: str, units: Column, moduli: Column, tweak: Column | str | None = None) -> tuple[Column, Column]:
    """A rule's condition and what it reads from a match."""
    tweak = F.lit(kind) if tweak is None else tweak
    return holds, F.struct(F.lit(kind).alias("kind"), units.alias("units"), moduli.alias("moduli"), tweak.alias("tweak"))


# Email: letters and digits are units, each within its own class; other characters have modulus 1.


def _email_part(m: Column) -> Column:
    """What changes: the local part, or all before the last label if the local part is short."""
    local = F.substring_index(m, "@", 1)
    short = F.length(F.regexp_replace(local, "[^A-Za-z0-9]", "")) < SHORT_LOCAL
    return F.when(short, F.regexp_extract(m, r"(?s)^(.*)\.[A-Za-z]+$", 1)).otherwise(local)


def _class_start(code: Column) -> Column:
    return F.when(code.between(48, 57), 48).when(code.between(65, 90), 65).when(code.between(97, 122), 97).otherwise(code)


def _read_email(m: Column) -> tuple[Column, Column]:
    codes = F.transform(_chars(_email_part(m)), lambda c: F.ascii(c))
    units = F.transform(codes, lambda c: c - _class_start(c))
    moduli = F.transform(codes, lambda c: F.when(_class_start(c) == 48, 10).when(_class_start(c).isin(65, 97), 26).otherwise(1))
    return _units(m.contains("@"), "email", units, moduli)


def _write_email(m: Column, units: Column) -> Column:
    new = F.zip_with(_chars(_email_part(m)), units, lambda c, u: F.chr(_class_start(F.ascii(c)) + u))
    return F.concat(F.array_join(new, ""), F.substring(m, F.size(units) + 1, F.length(m)))


def _read_ipv4(m: Column) -> tuple[Column, Column]:
    holds = m.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?!$)|$)){4}$")
    return _units(holds, "ipv4", F.transform(F.split(m, r"\."), lambda o: o.cast("int")), F.array_repeat(F.lit(256), 4))


def _write_ipv4(m: Column, units: Column) -> Column:
    return F.array_join(F.transform(units, lambda o: o.cast("string")), ".")


# Card: the first digit stays, the check digit is made anew, all between are units.


def _read_card(m: Column) -> tuple[Column, Column]:
    number = F.regexp_replace(m, "[ -]", "")
    holds = m.rlike(f"^(?:{CARD})$") & F.call_function("luhn_check", number)
    n = F.length(number) - 2
    tweak = F.concat(F.lit("card"), F.substring(number, 1, 1), n.cast("string"))
    return _units(holds, "card", F.slice(_digits(m), 2, n), _tens(n), tweak)


def _write_card(m: Column, units: Column) -> Column:
    def check_digit(body: Column) -> Column:
        # From the right, every other digit counts double, that before the check digit first.
        counted = F.transform(F.reverse(body), lambda d, i: F.when(i % 2 == 0, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d))
        return F.pmod(-F.aggregate(counted, F.lit(0), lambda s, d: s + d), F.lit(10))

    return _let(F.concat(F.slice(_digits(m), 1, 1), units), lambda body: _written(F.concat(body, F.array(check_digit(body))), m))


def _read_ssn(m: Column) -> tuple[Column, Column]:
    area, group, serial = (F.substring(m, at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    index = F.array(area - 1 - (area > 666).cast("int"), group - 1, serial - 1)
    return _units(m.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"), "ssn", index, _ints(SSN_UNITS))


def _write_ssn(m: Column, units: Column) -> Column:
    area = F.get(units, F.lit(0)) + 1
    parts = (_padded(area + (area >= 666).cast("int"), 3), _padded(F.get(units, F.lit(1)) + 1, 2), _padded(F.get(units, F.lit(2)) + 1, 4))
    return F.concat_ws("-", *parts)


# Phone: the ten national digits; area and exchange start with 2 to 9.


def _national(m: Column) -> Column:
    return F.regexp_extract(m, r"^(?:\+1[ .-]?)?(.*)$", 1)


def _read_phone(m: Column) -> tuple[Column, Column]:
    units = F.transform(_digits(_national(m)), lambda d, i: d - F.when(i.isin(0, 3), 2).otherwise(0))
    return _units(m.rlike(f"^(?:{PHONE})$"), "phone", units, _ints(PHONE_UNITS))


def _write_phone(m: Column, units: Column) -> Column:
    digits = F.transform(units, lambda d, i: d + F.when(i.isin(0, 3), 2).otherwise(0))
    return F.concat(F.regexp_extract(m, r"^(\+1[ .-]?)?", 0), _written(digits, _national(m)))


def _read_abroad(m: Column) -> tuple[Column, Column]:
    bare = F.regexp_replace(m, r"\D", "")
    n = F.length(bare) - 2
    holds = m.startswith("+") & n.between(6, 13)
    return _units(holds, "phone", F.slice(_digits(m), 3, n), _tens(n), F.concat(F.lit("abroad"), F.substring(bare, 1, 2)))


def _write_abroad(m: Column, units: Column) -> Column:
    return _written(F.concat(F.slice(_digits(m), 1, 2), units), m)


# Date: the number of its day, as two units.


def _read_date(m: Column) -> tuple[Column, Column]:
    part = lambda i: F.get(F.split(m, "[./-]"), F.lit(i))
    iso, dotted = m.contains("-"), m.contains(".")
    year = F.when(iso, part(0)).otherwise(part(2))
    month = F.when(iso | dotted, part(1)).otherwise(part(0))
    day = F.when(iso, part(2)).when(dotted, part(0)).otherwise(part(1))
    real = F.try_to_date(F.concat_ws("-", year, _padded(month, 2), _padded(day, 2)), "yyyy-MM-dd")
    count = F.datediff(real, F.lit(FIRST_DAY).cast("date"))
    holds = m.rlike(r"^\d+[./-]\d+[./-]\d+$") & count.between(0, DAY_UNITS[0] * DAY_UNITS[1] - 1)
    return _units(holds, "date", _let(count, lambda c: F.array(F.floor(c / DAY_UNITS[1]).cast("int"), c % DAY_UNITS[1])), _ints(DAY_UNITS))


def _write_date(m: Column, units: Column) -> Column:
    new = F.date_add(F.lit(FIRST_DAY).cast("date"), F.get(units, F.lit(0)) * DAY_UNITS[1] + F.get(units, F.lit(1)))
    brief = m.rlike(r"^\d[./]|[./]\d[./]")  # written without leading zeros

    def write(date: Column) -> Column:
        dotted = F.when(brief, F.date_format(date, "d.M.yyyy")).otherwise(F.date_format(date, "dd.MM.yyyy"))
        slashed = F.when(brief, F.date_format(date, "M/d/yyyy")).otherwise(F.date_format(date, "MM/dd/yyyy"))
        return F.when(m.contains("-"), F.date_format(date, "yyyy-MM-dd")).when(m.contains("."), dotted).otherwise(slashed)

    return _let(new, write)


# Date with the day first and above 12, which can't be read as month/day/year: the number of its day
# among such days, so that these dates are permuted among themselves.


def _late_before(month: Column) -> Column:
    """Days after the twelfth in all months before, counted from that of FIRST_DAY."""
    first = F.lit(FIRST_DAY).cast("date")
    return F.datediff(F.add_months(first, month), first) - 12 * month


def _read_late(m: Column) -> tuple[Column, Column]:
    day, month, year = (F.get(F.split(m, "/"), F.lit(i)) for i in range(3))
    real = F.try_to_date(F.concat_ws("-", year, _padded(month, 2), _padded(day, 2)), "yyyy-MM-dd")
    nth_month = (F.year(real) - int(FIRST_DAY[:4])) * 12 + F.month(real) - int(FIRST_DAY[5:7])
    count = _late_before(nth_month) + F.dayofmonth(real) - 13
    holds = m.rlike(r"^\d+/\d+/\d+$") & (F.dayofmonth(real) > 12) & nth_month.between(0, 4799)
    return _units(holds, "date", _let(count, lambda c: F.array(F.floor(c / LATE_UNITS[1]).cast("int"), c % LATE_UNITS[1])), _ints(LATE_UNITS), F.lit("day/month"))


def _write_late(m: Column, units: Column) -> Column:
    def date_of(count: Column) -> Column:
        near = F.floor(count * 4800 / (LATE_UNITS[0] * LATE_UNITS[1])).cast("int")  # or the month before or after

        def written(month: Column) -> Column:
            new = F.date_add(F.add_months(F.lit(FIRST_DAY).cast("date"), month), (12 + count - _late_before(month)).cast("int"))
            return F.when(m.rlike(r"/\d/"), F.date_format(new, "dd/M/yyyy")).otherwise(F.date_format(new, "dd/MM/yyyy"))

        month = F.when(_late_before(near + 1) <= count, near + 1).when(_late_before(near) <= count, near).otherwise(near - 1)
        return _let(month, written)

    return _let(F.get(units, F.lit(0)) * LATE_UNITS[1] + F.get(units, F.lit(1)), date_of)


# In the order in which they are tried.
RULES = (
    ("email", _read_email, _write_email),
    ("ipv4", _read_ipv4, _write_ipv4),
    ("card", _read_card, _write_card),
    ("ssn", _read_ssn, _write_ssn),
    ("phone", _read_phone, _write_phone),
    ("abroad", _read_abroad, _write_abroad),
    ("date", _read_date, _write_date),
    ("late", _read_late, _write_late),
)
_READ = "struct<kind:string,units:array<int>,moduli:array<int>,tweak:string>"


def _read(m: Column) -> Column:
    """(rule, match, read) of the first rule that holds; rule and read are null if none does."""
    out = F.struct(F.lit(None).cast("string").alias("rule"), m.alias("match"), F.lit(None).cast(_READ).alias("read"))
    for name, read, _ in reversed(RULES):
        holds, units = read(m)
        out = F.when(holds, F.struct(F.lit(name).alias("rule"), m.alias("match"), units.alias("read"))).otherwise(out)
    return out


def _written_anew(found: Column, units: Column) -> Column:
    out = found["match"]
    for name, _, write in reversed(RULES):
        out = F.when(found["rule"] == name, write(found["match"], units)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str = KEY, text: str = "text", undo: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and pii_kinds (in order of place) and pii_count added."""
    body = F.col(text)
    own = [c for c in docs.columns if c not in ("pii_kinds", "pii_count")]
    hinted = F.coalesce(body.rlike(HINT), F.lit(False))
    found = docs.select(*own, F.when(hinted, F.regexp_extract_all(body, F.lit(ANY), F.lit(0))).alias("_matches"))
    read = found.select(*own, F.when(F.size("_matches") > 0, F.transform("_matches", _read)).alias("_read"))
    turned = F.transform(
        "_read", lambda r: F.when(r["rule"].isNotNull(), feistel(r["read"]["units"], r["read"]["moduli"], r["read"]["tweak"], key, undo=undo))
    )
    permuted = read.select(*own, "_read", turned.alias("_units"))
    new = F.zip_with("_read", "_units", _written_anew)
    kinds = F.filter(F.transform("_read", lambda r: r["read"]["kind"]), lambda k: k.isNotNull())
    written = permuted.select(*own, new.alias("_new"), F.coalesce(kinds, F.array().cast("array<string>")).alias("pii_kinds"))
    # The gaps between matches and the new values take turns.
    joined = F.array_join(F.transform(F.split(body, ANY, -1), lambda g, i: F.concat(F.coalesce(F.get(F.col("_new"), i - 1), F.lit("")), g)), "")
    out = written.withColumn(text, F.when(F.size("pii_kinds") > 0, joined).otherwise(body))
    return out.withColumn("pii_count", F.size("pii_kinds")).select(*own, "pii_kinds", "pii_count")
