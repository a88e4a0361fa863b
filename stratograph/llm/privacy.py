"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

Numbers and dates that pass their kind's validation are permuted by a keyed Feistel network within the valid values of their
format: equal values get equal pseudonyms in every document, different ones different pseudonyms, and a pseudonym validates as
the value did. E-mail addresses and long hexadecimal secrets, which are no numbers, get keyed characters of the same classes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

#: The formats. Each begins where no word, number or address goes on, and repeats give back nothing or are short, so
#: a text is read once: an address gives back at most eight labels, as the last may end a sentence. Groups are not captured.
_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_.@+-])", r"(?![\p{L}\p{N}_@]|[.-]\p{N})"
_PHONES = (
    r"\+[0-9]{1,3}[ .-]?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}",  # +1 (017) 555-7713
    r"\+[0-9]{1,3}[ .-][0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}",  # +44 20 7946 0958
    r"\+[0-9]{1,3}[ .-][0-9]{2,4}[ .-][0-9]{6,8}",  # +49 170 1234567
    r"\+[0-9]{1,3}\.[0-9]{1,4}(?:\.[0-9]{2,4}){2,4}",  # +33.1.23.45.67.89
    r"\+[0-9](?:\)?[ -]?\(?[0-9]){6,14}",  # any other grouping of 7 to 15 digits, and none: +491701234567
    r"(?:1[ .-]|1(?=\())?\(?[0-9]{3}(?:\)[ .-]?|[ .-])[0-9]{3}[ .-][0-9]{4}",  # 1-800-555-1234, (555)123-4567, 555.123.4567
)
FORMATS = {
    "email": r"(?<![\p{L}\p{N}_%+-])(?<![\p{L}\p{N}_%+-]\.)[\p{L}\p{N}_%+-][\p{L}\p{N}_.%+-]{0,63}+@(?:[\p{L}\p{N}-]{1,63}+\.){1,8}\p{L}{2,24}+",
    "secret": r"(?<![\p{L}\p{N}_])(?=[0-9a-fA-F]{0,63}[0-9])[0-9a-fA-F]{32,64}+(?![\p{L}\p{N}_])",
    "ip": _BEFORE + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + _AFTER,
    "phone": r"(?<![\p{L}\p{N}_.@-])(?:" + "|".join(_PHONES) + ")" + _AFTER,
    "ssn": _BEFORE + r"[0-9]{3}-[0-9]{2}-[0-9]{4}" + _AFTER,
    "iso_date": _BEFORE + r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}(?:(?=T[0-9]{2}:[0-9]{2})|" + _AFTER + ")",
    "dot_date": _BEFORE + r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}" + _AFTER,
    "slash_date": _BEFORE + r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}" + _AFTER,
    "card": _BEFORE + r"(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}(?:[ -][0-9]{3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{4,5})" + _AFTER,
}
_ANY = "|".join(FORMATS.values())
_DATE_PATTERN = {"iso_date": "yyyy-MM-dd", "dot_date": "dd.MM.yyyy", "slash_date": "MM/dd/yyyy"}
#: A month or a day of one digit, as in 2024-1-5; such a date is written without leading zeros again.
_SHORT = r"(?<![0-9])[0-9](?![0-9])"
#: Dates are permuted within 400 years, after which the calendar repeats: 146097 days, 189 times 773.
_FIRST_DAY, _DATE_SIDES = "1800-01-01", (189, 773)
#: Country codes of one and two digits; all others have three.
_COUNTRY = r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
_SSN_SIDES = (898, 99 * 9999)
#: Dates with the day first (31/12/1999) are known by days over 12: the months of 400 years, and days from 13 to 31, of which 97 % are
#: dates. What is none is permuted on, at most so often (it takes more with a probability of 1e-12, and then stays).
_DAY_FIRST, _WALK = (4800, 19), 8


#: The column that carries the key from its subquery to the expressions.
KEY = "_key_of_pseudonyms"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _feistel(kind: str, left: Column, right: Column, left_size: Column, right_size: Column, secret: Column | str) -> Column:
    """Permute pairs (left, right) with 0 <= left < left_size and 0 <= right < right_size: a struct of new left and right.

    Rounds in turn add to one side a keyed hash of the other, modulo the side's size. Each round can be undone, so the
    whole is a permutation whatever the sizes.
    """

    def noise(i: Column, value: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(secret), F.lit(kind), left_size.cast("string"), right_size.cast("string"), i.cast("string"), value.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)

    def one(state: Column, i: Column) -> Column:
        a, b = state["a"], state["b"]
        return F.when(i % 2 == 0, F.struct(F.pmod(a + noise(i, b, left_size), left_size).alias("a"), b.alias("b"))).otherwise(
            F.struct(a.alias("a"), F.pmod(b + noise(i, a, right_size), right_size).alias("b"))
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("a"), right.cast("long").alias("b")), one)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def _permute_digits(kind: str, digits: Column, secret: Column) -> Column:
    """Permute strings of 2 to 20 digits among strings of equal length."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    new = _feistel(kind, F.left(digits, half), F.substr(digits, half + 1, n - half), _power(half), _power(n - half), secret)
    return _let(new, lambda x: F.concat(F.lpad(x["a"].cast("string"), half, "0"), F.lpad(x["b"].cast("string"), n - half, "0")))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _laid_out(value: Column, digits: Column, skip: Column) -> Column:
    """``value`` with ``digits`` in the places of its own, after the first ``skip`` of these."""
    place = lambda i: F.length(_digits(F.substr(value, F.lit(1), i)))
    one = lambda i: F.substr(value, i, F.lit(1))
    new = F.transform(F.sequence(F.lit(1), F.length(value)), lambda i: F.when(one(i).rlike("[0-9]") & (place(i) > skip), F.substr(digits, place(i) - skip, F.lit(1))).otherwise(one(i)))
    return F.array_join(new, "")


def _luhn_sum(digits: Column, doubled_first: Column) -> Column:
    """Luhn sum from the right; ``doubled_first``: whether the last digit is doubled."""
    n = F.length(digits)

    def one(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = (i % 2 == 0) == doubled_first
        return total + F.when(twice, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), one)


def _card(value: Column, secret: Column) -> Column:
    def checked(body: Column) -> Column:
        return F.concat(body, F.pmod(-_luhn_sum(body, F.lit(True)), F.lit(10)).cast("string"))

    def moved(digits: Column) -> Column:
        new = _let(_permute_digits("card", F.left(digits, F.length(digits) - 1), secret), checked)
        return F.when(_luhn_sum(digits, F.lit(False)) % 10 == 0, _let(new, lambda x: _laid_out(value, x, F.lit(0))))

    return _let(_digits(value), moved)


def _phone(value: Column, secret: Column) -> Column:
    """The country code stays, and the 1 before ten digits; so a number gets the same new digits with and without them."""
    written = F.length(F.regexp_extract(value, r"^\+([0-9]+)", 1))
    listed = F.length(F.regexp_extract(value, _COUNTRY, 1))
    country = F.when(written > 3, listed).when((written == 0) & (F.length(_digits(value)) == 11), 1).otherwise(written)

    def moved(kept: Column) -> Column:
        national = F.substr(_digits(value), kept + 1, F.length(value))
        return _let(_let(national, lambda x: _permute_digits("phone", x, secret)), lambda x: _laid_out(value, x, kept))

    return _let(country, moved)


def _ip(value: Column, secret: Column) -> Column:
    def moved(parts: Column) -> Column:
        new = _feistel("ip", parts[0] * 256 + parts[1], parts[2] * 256 + parts[3], F.lit(65536), F.lit(65536), secret)
        octets = lambda x: F.concat_ws(".", *(o.cast("string") for side in ("a", "b") for o in (F.shiftright(x[side], 8), x[side] % 256)))
        return F.when(F.forall(parts, lambda p: p <= 255), _let(new, octets))

    return _let(F.transform(F.split(value, r"\."), lambda p: p.cast("long")), moved)


def _ssn(value: Column, secret: Column) -> Column:
    sides = [F.lit(n).cast("long") for n in _SSN_SIDES]

    def moved(part: Column) -> Column:
        area, group, serial = part[0], part[1], part[2]
        valid = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
        new = _feistel("ssn", area - 1 - F.when(area > 666, 1).otherwise(0), (group - 1) * 9999 + serial - 1, *sides, secret)
        text = lambda x: F.concat_ws(
            "-",
            F.lpad((x["a"] + 1 + F.when(x["a"] >= 665, 1).otherwise(0)).cast("string"), 3, "0"),
            F.lpad((F.floor(x["b"] / 9999) + 1).cast("string"), 2, "0"),
            F.lpad((x["b"] % 9999 + 1).cast("string"), 4, "0"),
        )
        return F.when(valid, _let(new, text))

    return _let(F.transform(F.split(value, "-"), lambda p: p.cast("long")), moved)


def _date(kind: str, value: Column, secret: Column) -> Column:
    a, b = (F.lit(n).cast("long") for n in _DATE_SIDES)
    pattern = _DATE_PATTERN[kind]

    def written(date: Column, pattern: str) -> Column:
        return F.when(value.rlike(_SHORT), F.date_format(date, pattern.replace("MM", "M").replace("dd", "d"))).otherwise(F.date_format(date, pattern))

    def moved(day: Column) -> Column:
        new = _feistel("date", F.floor(day / b), F.pmod(day, b), a, b, secret)
        text = lambda x: written(F.date_add(F.lit(_FIRST_DAY).cast("date"), (x["a"] * b + x["b"]).cast("int")), pattern)
        return F.when((day >= 0) & (day < a * b), _let(new, text))

    date = F.try_to_timestamp(value, F.lit(pattern.replace("MM", "M").replace("dd", "d"))).cast("date")
    if kind != "slash_date":
        return _let(F.datediff(date, F.lit(_FIRST_DAY)), moved)
    return F.coalesce(_let(F.datediff(date, F.lit(_FIRST_DAY)), moved), _let(F.try_to_timestamp(value, F.lit("d/M/yyyy")).cast("date"), lambda d: _day_first(d, written, secret)))


def _day_first(date: Column, written: Callable[[Column, str], Column], secret: Column) -> Column:
    """Permute a date with a day over 12 among those."""
    months, days = (F.lit(n).cast("long") for n in _DAY_FIRST)
    first = int(_FIRST_DAY[:4])
    made = lambda x: F.try_make_timestamp(F.floor(x["a"] / 12).cast("int") + first, F.pmod(x["a"], 12).cast("int") + 1, x["b"].cast("int") + 13, F.lit(0), F.lit(0), F.lit(0)).cast("date")
    start = F.struct(((F.year(date) - first) * 12 + F.month(date) - 1).cast("long").alias("a"), (F.dayofmonth(date) - 13).cast("long").alias("b"), F.lit(0).alias("n"))

    def step(state: Column, _: Column) -> Column:
        new = _feistel("day first", state["a"], state["b"], months, days, secret)
        return F.when((state["n"] > 0) & made(state).isNotNull(), state).otherwise(_let(new, lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), (state["n"] + 1).alias("n"))))

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(_WALK)), start, step)
    inside = (F.year(date) >= first) & (F.year(date) < first + 400) & (F.dayofmonth(date) > 12)
    return F.when(inside, _let(walked, lambda x: written(made(x), "dd/MM/yyyy")))


def _like(kind: str, value: Column, keep_from: Column, secret: Column) -> Column:
    """Keyed characters of the same class in place of letters and digits up to ``keep_from``."""

    def moved(digest: Column) -> Column:
        def one(i: Column) -> Column:
            c = F.substr(value, i, F.lit(1))
            noise = F.conv(F.substr(digest, F.pmod(2 * i, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int")
            letters = 6 if kind == "secret" else 26
            return (
                F.when(i >= keep_from, c)
                .when(c.rlike("[0-9]"), (noise % 10).cast("string"))
                .when(c.rlike(r"\p{Lu}"), F.char(F.lit(65) + noise % letters))
                .when(c.rlike(r"\p{L}"), F.char(F.lit(97) + noise % letters))
                .otherwise(c)
            )

        return F.array_join(F.transform(F.sequence(F.lit(1), F.length(value)), one), "")

    return _let(F.sha2(F.concat_ws("|", secret, F.lit(kind), value), 512), moved)


def _pseudonym(value: Column, secret: Column) -> Column:
    """The pseudonym of a match, by its format; what doesn't validate stays."""
    new = {
        "email": _like("email", value, F.locate("@", value), secret),
        "secret": _like("secret", value, F.length(value) + 1, secret),
        "ip": _ip(value, secret),
        "phone": _phone(value, secret),
        "ssn": _ssn(value, secret),
        "card": _card(value, secret),
    } | {kind: _date(kind, value, secret) for kind in _DATE_PATTERN}
    chosen = F
    for kind, pattern in FORMATS.items():
        chosen = chosen.when(value.rlike(f"^(?:{pattern})$"), new[kind])
    return F.coalesce(chosen, value)


def pseudonymize(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced by pseudonyms under the key ``secret``; all columns stay.

    Card numbers (Luhn), IPv4 addresses, telephone numbers, US social security numbers and dates (to 400 years from 1800, as
    yyyy-mm-dd, dd.mm.yyyy or mm/dd/yyyy, or dd/mm/yyyy where the day tells, with one digit for a month or day or with two) are
    permuted within their valid values, so a few stay what they are; e-mail names (to 64 characters, of at most 9 labels) and
    hexadecimal secrets of 32 to 64 digits get keyed characters, which may fall together. IPv6 addresses and IBANs aren't looked for.
    The key stands in no plan: it is a subquery's value, which every task is sent. Telephone numbers have a plus sign and 7 to 15 digits, grouped or not, or are three, three and
    four digits set apart; bare runs of digits without a plus sign are taken for card numbers only. A text keeps its length but for IPv4 addresses and dates
    with one digit for a month or day. Whatever doesn't validate, and null and
    empty texts, stay as they are. Null keys, repeated rows and empty tables need nothing special. A row is handled by
    itself: no shuffle, no Python.
    """
    column, key = F.col(f"`{text}`"), F.col(KEY)
    gaps, found = F.split(column, _ANY, -1), F.regexp_extract_all(column, F.lit(_ANY), F.lit(0))
    new = F.transform(found, lambda value: _pseudonym(value, key))
    parts = F.zip_with(gaps, new, lambda gap, name: F.concat(gap, F.coalesce(name, F.lit(""))))
    replaced = F.when(column.rlike(_ANY), F.array_join(parts, "")).otherwise(column)
    keys = docs.sparkSession.sql("SELECT * FROM VALUES (:secret) AS keys (secret)", {"secret": secret})
    return docs.withColumn(KEY, keys.scalar()).withColumn(text, replaced).drop(KEY)
