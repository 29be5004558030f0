"""Format-preserving pseudonyms for personal data, with DataFrame functions only.

One pattern finds candidates; each is validated (Luhn check digit, calendar, octets, blocks of numbers never issued) and
replaced by a value of the same format under a keyed Feistel permutation, so that equal values stay equal, and linked,
across documents while different ones stay different. Digits keep their separators. Mail addresses have no number to
permute; they get a keyed digest as their name. Everything else of a text is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linescope.llm.common import unused

#: Patterns of candidates by kind, most specific first.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"(?<![\p{L}\p{N}+])(?:"
    r"\+?(?:\d{1,3}[ .-]?)?\(\d{3}\) ?\d{3}[ .-]?\d{4}"
    r"|\+\d{1,3}[ .-]\d{3}[ .-]\d{3}[ .-]\d{4}"
    r"|\+\d{10,15}"
    r"|\+\d{1,3}(?:[ .-]\d{1,5}){2,6}"
    r"|(?<![.-])(?:1[ .-])?\d{3}([.-])\d{3}\1\d{4}"
    r"|(?<![.-])(?:1[ -])?[2-9]\d{2} [2-9]\d{2} \d{4}"
    r")(?![\p{L}\p{N}])",
    "date": r"(?<![\p{L}\p{N}./-])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\p{L}\p{N}])",
    "ip": r"(?<![\p{L}\p{N}.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)(?!\p{L})",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}-])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?![\p{L}\p{N}])",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
ROUNDS = 8
#: Dates from 1900-01-01 to 2099-12-31, permuted as numbers below LEFT * RIGHT, walking on until one is a date.
FIRST_DAY, DAYS, LEFT, RIGHT = "1900-01-01", 73_049, 271, 270


def _random(key: str, kind: Column | str, turn: Column, value: Column) -> Column:
    """60 keyed pseudo-random bits of a half, for a Feistel round."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    message = F.concat_ws("|", F.lit(key), kind, turn.cast("string"), value.cast("string"))
    return F.conv(F.substring(F.sha2(message.cast("binary"), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: Column | str, left: Column, right: Column, below_left: Column, below_right: Column) -> Column:
    """A struct (a, b) permuting pairs a < below_left, b < below_right: rounds add to each half by turns."""
    start = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def turn(half: Column, i: Column) -> Column:
        a = F.when(i % 2 == 0, (half["a"] + _random(key, kind, i, half["b"]) % below_left) % below_left).otherwise(half["a"])
        b = F.when(i % 2 == 1, (half["b"] + _random(key, kind, i, half["a"]) % below_right) % below_right).otherwise(half["b"])
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permuted_digits(key: str, kind: str, digits: Column) -> Column:
    """A string of up to 19 digits permuted among those of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    tag = F.concat(F.lit(f"{kind}/"), n.cast("string"))
    pair = feistel(key, tag, digits.substr(F.lit(1), u), digits.substr(u + 1, n - u), ten(u), ten(n - u))
    # one evaluation of the pair: an array of one element is mapped to its string
    left = lambda p: F.when(u > 0, F.lpad(p["a"].cast("string"), u, "0")).otherwise(F.lit(""))
    return F.element_at(F.transform(F.array(pair), lambda p: F.concat(left(p), F.lpad(p["b"].cast("string"), n - u, "0"))), 1)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits to which a check digit is still to be appended."""
    reverse = F.split(F.reverse(digits), "")

    def add(acc: Column, d: Column) -> Column:
        twice = d.cast("int") * 2
        value = F.when(acc["i"] % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d.cast("int"))
        return F.struct((acc["i"] + 1).alias("i"), (acc["s"] + value).alias("s"))

    return F.aggregate(reverse, F.struct(F.lit(0).alias("i"), F.lit(0).alias("s")), add, lambda acc: acc["s"])


def check_digit(digits: Column) -> Column:
    return ((F.lit(10) - luhn_sum(digits) % 10) % 10).cast("string")


def refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in order, by ``digits``."""

    def put(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("^[0-9]$")
        return F.struct(
            F.concat(acc["s"], F.when(is_digit, digits.substr(acc["i"], F.lit(1))).otherwise(c)).alias("s"),
            (acc["i"] + is_digit.cast("int")).alias("i"),
        )

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("i")), put, lambda acc: acc["s"])


def _date(key: str, m: Column, d: Column) -> Column:
    """Year first, or day first; with slashes month first, if it is no date otherwise.

    Such a month-first date becomes one that is no date otherwise either (its day is over 12), so that no day-first date
    has the same pseudonym.
    """
    parsed = lambda *at: F.try_to_date(F.concat_ws("-", *[d.substr(i, n) for i, n in at]), "yyyy-MM-dd")
    iso = m.rlike(r"^\d{4}[-/]")
    day_first = parsed((5, 4), (3, 2), (1, 2))
    month_first = ~iso & day_first.isNull() & m.contains("/")
    day = F.when(iso, parsed((1, 4), (5, 2), (7, 2))).when(month_first, parsed((5, 4), (1, 2), (3, 2))).otherwise(day_first)
    number = F.datediff(day, F.lit(FIRST_DAY).cast("date"))
    at = lambda v: F.date_add(F.lit(FIRST_DAY).cast("date"), v.cast("int"))

    def permute(v: Column) -> Column:
        pair = feistel(key, "date", F.floor(v / RIGHT), v % RIGHT, F.lit(LEFT), F.lit(RIGHT))
        return F.element_at(F.transform(F.array(pair), lambda p: p["a"] * RIGHT + p["b"]), 1)

    def fits(v: Column) -> Column:
        return (v < DAYS) & (~month_first | (F.dayofmonth(at(v)) > 12))

    # of LEFT * RIGHT numbers 121 are no date, and three fifths of dates have a day over 12: 32 misses do not happen
    start = number.cast("long") + F.lit(LEFT * RIGHT)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(32)), start, lambda v, _: F.when(fits(v), v).otherwise(permute(v % (LEFT * RIGHT))))
    out = F.date_format(at(walked), "yyyyMMdd")
    year, month, of_month = out.substr(1, 4), out.substr(5, 2), out.substr(7, 2)
    digits = F.when(iso, out).when(month_first, F.concat(month, of_month, year)).otherwise(F.concat(of_month, month, year))
    return F.when(number.between(0, DAYS - 1), refill(m, digits))


def _ip(key: str, m: Column) -> Column:
    octet = lambda i: F.split_part(m, F.lit("."), F.lit(i)).cast("long")
    valid = F.greatest(*map(octet, (1, 2, 3, 4))) <= 255
    pair = feistel(key, "ip", octet(1) * 256 + octet(2), octet(3) * 256 + octet(4), F.lit(65_536), F.lit(65_536))
    halves = lambda v: (F.floor(v / 256).cast("string"), (v % 256).cast("string"))
    return F.when(valid, F.element_at(F.transform(F.array(pair), lambda p: F.concat_ws(".", *halves(p["a"]), *halves(p["b"]))), 1))


def _issued(digits: Column) -> Column:
    """Whether a social security number can have been issued."""
    return ~digits.rlike(r"^(000|666|9)|^\d{3}00|0000$")


def _ssn(key: str, d: Column) -> Column:
    """An issued number for an issued one: permuted until it is one, which no number that is left in clear can be.

    A ninth of all numbers are not issued: 32 misses do not happen.
    """
    permute = lambda v: permuted_digits(key, "ssn", v)
    return F.aggregate(F.sequence(F.lit(1), F.lit(32)), permute(d), lambda v, _: F.when(_issued(v), v).otherwise(permute(v)))


def kind_of(m: Column) -> Column:
    """The kind of a candidate by its form."""
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip")
        .when(m.rlike(r"^(\d{4}[-/]\d{2}[-/]\d{2}|\d{2}[/.]\d{2}[/.]\d{4})$"), "date")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(m.rlike(r"^[+(]|[()]|^(1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}$"), "phone")
        .otherwise("card")
    )


def pseudonym(key: str, m: Column) -> Column:
    """The pseudonym of a candidate, null if it is not valid."""
    d = F.regexp_replace(m, "[^0-9]", "")
    n, kind = F.length(d), kind_of(m)
    last = permuted_digits(key, "phone", d.substr(n - 9, F.lit(10)))
    payload = permuted_digits(key, "card", d.substr(F.lit(1), n - 1))
    card = F.element_at(F.transform(F.array(payload), lambda p: F.concat(p, check_digit(p))), 1)
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)).cast("binary"), 256)
    return (
        F.when(kind == "email", F.concat(F.lit("user"), digest.substr(1, 12), F.lit("@"), digest.substr(13, 6), F.lit(".invalid")))
        .when(kind == "ip", _ip(key, m))
        .when(kind == "date", _date(key, m, d))
        .when(kind == "ssn", F.when(_issued(d), refill(m, _ssn(key, d))))
        .when(kind == "phone", F.when(n.between(10, 15), refill(m, F.concat(d.substr(F.lit(1), n - 10), last))))
        .otherwise(F.when(luhn_sum(d.substr(F.lit(1), n - 1)) % 10 == (F.lit(10) - d.substr(n, F.lit(1)).cast("int")) % 10, refill(m, card)))
    )


def pseudonymised(text: Column, key: str) -> Column:
    """A struct of the new ``text`` and ``found``, the (kind, valid) of its candidates; a null text stays null."""
    pattern = F.lit(PATTERN)
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: F.struct(m.alias("old"), pseudonym(key, m).alias("new")))
    pieces = lambda new: F.zip_with(
        F.split(text, PATTERN, -1), new, lambda gap, x: F.concat(gap, F.coalesce(x["new"], x["old"], F.lit("")))
    )
    whole = F.transform(
        F.array(found),
        lambda f: F.struct(
            F.array_join(pieces(f), "").alias("text"),
            F.transform(f, lambda x: F.struct(kind_of(x["old"]).alias("kind"), x["new"].isNotNull().alias("valid"))).alias("found"),
        ),
    )
    none = F.struct(text.alias("text"), F.expr("cast(array() as array<struct<kind: string, valid: boolean>>)").alias("found"))
    return F.when(text.rlike("[0-9@]"), F.element_at(whole, 1)).otherwise(none)


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counts: bool = True) -> DataFrame:
    """``docs`` with ``text`` pseudonymised under ``key``; with ``counts``, ``n_<kind>`` of replaced values for each kind.

    Null and empty texts stay as they are, with counts of 0. Columns of ``docs`` with the name of a count are replaced by
    it, and kept without ``counts``. Candidates that fail their check stay in the text. The same key gives the same
    pseudonyms in every run and table.
    """
    name = unused("__done", docs.columns)
    done = docs.withColumn(name, pseudonymised(F.col(text), key))
    found = {f"n_{k}": _count(name, k) for k in PATTERNS} if counts else {}
    return done.withColumns({text: F.col(f"{name}.text"), **found}).drop(name)


def _count(name: str, kind: str) -> Column:
    return F.size(F.filter(f"{name}.found", lambda x: x["valid"] & (x["kind"] == kind))).cast("long")
