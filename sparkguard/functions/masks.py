"""Masking strategies as column expressions.

Each takes the column, the secret key and the column's name and returns a column of the same type.
Nulls stay null. No Python runs per row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkguard.functions import words
from sparkguard.functions.digest import (
    digest,
    digit_supply,
    fraction,
    slot,
    strong_digest,
    supply,
)
from sparkguard.functions.numbers import decimals, magnitude, number_text

Mask = Callable[[Column, str, str], Column]


def _pick(items: list[str], n: Column) -> Column:
    return F.get(F.array(*[F.lit(x) for x in items]), (n % len(items)).cast("int"))


def _digits(n: Column, width: int) -> Column:
    return F.lpad((n % 10**width).cast("string"), width, "0")


def _chars(value: Column) -> Column:
    return F.split(value, "")


def _once(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with the value computed a single time."""
    return F.get(F.transform(F.array(value), build), F.lit(0))


def first_name(value: Column, key: str, column: str) -> Column:
    return _pick(words.FIRST_NAMES, slot(digest(value, key, column), 0))


def last_name(value: Column, key: str, column: str) -> Column:
    return _pick(words.LAST_NAMES, slot(digest(value, key, column), 1))


def full_name(value: Column, key: str, column: str) -> Column:
    return F.concat(first_name(value, key, column), F.lit(" "), last_name(value, key, column))


def email(value: Column, key: str, column: str) -> Column:
    h = digest(value, key, column)
    return F.concat(
        F.lower(_pick(words.FIRST_NAMES, slot(h, 0))),
        F.lit("."),
        F.lower(_pick(words.LAST_NAMES, slot(h, 1))),
        (slot(h, 2) % 1000).cast("string"),
        F.lit("@example."),
        _pick(words.TLDS, slot(h, 3)),
    )


def replace_digits(value: Column, key: str, column: str) -> Column:
    """Every digit replaced, everything else kept."""
    drawn = F.substr(digit_supply(digest(value, key, column), F.length(value)), F.lit(1), F.length(value))
    return F.array_join(F.zip_with(_chars(value), _chars(drawn), lambda c, d: F.when(c.between("0", "9"), d).otherwise(c)), "")


def _digit_count(value: Column) -> Column:
    return F.length(F.regexp_replace(value, "[^0-9]", ""))


def phone(value: Column, key: str, column: str) -> Column:
    """Ten digits or more keep their format; anything shorter becomes a fresh number."""
    h = digest(value, key, column)
    fresh = F.concat(
        F.lit("("), (F.lit(200) + slot(h, 0) % 800).cast("string"), F.lit(") "), _digits(slot(h, 1), 3), F.lit("-"), _digits(slot(h, 2), 4)
    )
    return F.when(_digit_count(value) >= 10, replace_digits(value, key, column)).otherwise(fresh)


def ssn(value: Column, key: str, column: str) -> Column:
    h = digest(value, key, column)
    return F.concat(_digits(slot(h, 0), 3), F.lit("-"), _digits(slot(h, 1), 2), F.lit("-"), _digits(slot(h, 2), 4))


def address(value: Column, key: str, column: str) -> Column:
    h = digest(value, key, column)
    number = (F.lit(1) + slot(h, 0) % 9999).cast("string")
    return F.concat(number, F.lit(" "), _pick(words.STREETS, slot(h, 1)), F.lit(" "), _pick(words.STREET_KINDS, slot(h, 2)))


def city(value: Column, key: str, column: str) -> Column:
    return _pick(words.CITIES, slot(digest(value, key, column), 0))


def state(value: Column, key: str, column: str) -> Column:
    return _pick(words.STATES, slot(digest(value, key, column), 0))


def zipcode(value: Column, key: str, column: str) -> Column:
    return zipcode_number(value, key, column).cast("string")


def zipcode_number(value: Column, key: str, column: str) -> Column:
    return F.lit(10000) + slot(digest(value.cast("string"), key, column), 0) % 90000


def _luhn_digit(payload: Column) -> Column:
    """Check digit for a text of digits."""
    from_right = F.transform(
        _chars(F.reverse(payload)),
        lambda c, i: F.when(i % 2 == 0, (c.cast("int") * 2) - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")),
    )
    total = F.aggregate(from_right, F.lit(0), lambda acc, x: acc + x)
    return ((F.lit(10) - total % 10) % 10).cast("string")


def credit_card(value: Column, key: str, column: str) -> Column:
    """Thirteen digits or more keep their format; the last digit is a Luhn check digit."""

    def checked(replaced: Column) -> Column:
        digits = F.regexp_replace(replaced, "[^0-9]", "")
        check = _once(digits, lambda d: _luhn_digit(F.substr(d, F.lit(1), F.length(d) - 1)))
        return F.regexp_replace(replaced, F.lit("[0-9]([^0-9]*)$"), F.concat(check, F.lit("$1")))

    kept = _once(replace_digits(value, key, column), checked)
    payload = F.concat(F.lit("4"), F.substring(digit_supply(digest(value, key, column), F.lit(1)), 1, 14))
    fresh = _once(payload, lambda p: F.concat(p, _luhn_digit(p)))
    count = _digit_count(value)
    return F.when(count >= 13, kept).when(count < 13, fresh)


def _prefixed(prefix: str, width: int) -> Mask:
    lo = 10 ** (width - 1)

    def mask(value: Column, key: str, column: str) -> Column:
        h = digest(value, key, column)
        wide = slot(h, 0) * 65536 + slot(h, 1) % 65536
        return F.concat(F.lit(prefix), (F.lit(lo) + wide % (9 * lo)).cast("string"))

    return mask


# The prefixes and digit counts of the business identifiers.
account_number = _prefixed("ACC", 10)
business_id = _prefixed("BIZ", 6)
transaction_id = _prefixed("TXN", 9)
medical_id = _prefixed("MRN", 7)




def amount(value: Column, key: str, column: str) -> Column:
    """Same sign, order of magnitude and decimal places; zero stays zero."""
    h = digest(number_text(value), key, column)
    low = F.pow(F.lit(10.0), magnitude(value))
    scale = F.pow(F.lit(10.0), decimals(value))
    drawn = low + fraction(h) * (low * 10 - 1 - low)
    masked = F.round(drawn * scale) / scale * F.when(value < 0, -1.0).otherwise(1.0)
    return F.when(value.isNull() | (value == 0), value).otherwise(masked)


def whole_amount(value: Column, key: str, column: str) -> Column:
    """As ``amount`` for integer columns."""
    h = digest(value.cast("string"), key, column)
    low = F.pow(F.lit(10.0), magnitude(value)).cast("long")
    masked = (low + slot(h, 0) % (low * 9)) * F.when(value < 0, -1).otherwise(1)
    return F.when(value.isNull() | (value == 0), value).otherwise(masked)


def hashed(value: Column, key: str, column: str) -> Column:
    return strong_digest(value, key, column)


def api_key(value: Column, key: str, column: str) -> Column:
    pairs = F.regexp_extract_all(strong_digest(value, key, column), F.lit(".."), F.lit(0))
    letter = F.transform(pairs, lambda p: F.substr(F.lit(words.ALPHABET), (F.conv(p, 16, 10).cast("int") % len(words.ALPHABET)) + 1, F.lit(1)))
    return F.array_join(letter, "")


def ipv4(value: Column, key: str, column: str) -> Column:
    h = digest(value, key, column)
    first, *rest = [(slot(h, i) % 256).cast("string") for i in range(4)]
    return F.concat(first, *[x for r in rest for x in (F.lit("."), r)])


def company(value: Column, key: str, column: str) -> Column:
    h = digest(value, key, column)
    return F.concat(_pick(words.LAST_NAMES, slot(h, 0)), F.lit(" "), _pick(words.COMPANY_KINDS, slot(h, 1)))


def partial(value: Column, key: str = "", column: str = "", preserve_length: bool = True) -> Column:
    """Keep the ends of a text, cross out its middle."""
    n = F.length(value)
    short = F.repeat(F.lit("X"), n) if preserve_length else F.lit("XX")
    middle = F.repeat(F.lit("X"), n - 4) if preserve_length else F.lit("XXX")
    ends = F.concat(F.substring(value, 1, 1), F.repeat(F.lit("X"), n - 2), F.substring(value, -1, 1))
    long = F.concat(F.substring(value, 1, 2), middle, F.substring(value, -2, 2))
    return F.when(n <= 2, short).when(n <= 4, ends).otherwise(long)


def shuffle(value: Column, key: str, column: str) -> Column:
    """The same characters in an order drawn from the digest."""
    drawn = F.substr(supply(digest(value, key, column), F.length(value) * 8), F.lit(1), F.length(value) * 8)
    tagged = F.zip_with(
        F.regexp_extract_all(drawn, F.lit(".{8}"), F.lit(0)), _chars(value), lambda k, c: F.struct(k.alias("k"), c.alias("c"))
    )
    return F.array_join(F.transform(F.array_sort(tagged), lambda s: s["c"]), "")


def keyword_text(value: Column, key: str = "", column: str = "") -> Column:
    n = F.length(value)
    ends = F.concat(F.substring(value, 1, 1), F.repeat(F.lit("X"), n - 2), F.substring(value, -1, 1))
    return F.when(n <= 3, F.repeat(F.lit("X"), n)).otherwise(ends)


def jitter(value: Column, key: str, column: str) -> Column:
    """A double moved by at most ten per cent, never below zero."""
    h = digest(number_text(value), key, column)
    moved = value + F.abs(value) * 0.1 * (fraction(h) * 2 - 1)
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), moved))


def whole_jitter(value: Column, key: str, column: str) -> Column:
    """An integer moved by at most a tenth of itself, never below zero."""
    h = digest(value.cast("string"), key, column)
    span = F.floor(F.abs(value) / 10).cast("long")
    moved = value + slot(h, 0) % (span * 2 + 1) - span
    return F.when(value.isNotNull(), F.greatest(F.lit(0).cast("long"), moved.cast("long")))


STRATEGIES: dict[str, Mask] = {
    "fake_email": email,
    "fake_name": full_name,
    "fake_first_name": first_name,
    "fake_last_name": last_name,
    "fake_phone": phone,
    "fake_ssn": ssn,
    "fake_address": address,
    "fake_city": city,
    "fake_state": state,
    "fake_zipcode": zipcode,
    "fake_credit_card": credit_card,
    "fake_account_number": account_number,
    "fake_business_id": business_id,
    "fake_transaction_id": transaction_id,
    "randomize_amount": amount,
    "fake_hash": hashed,
    "fake_api_key": api_key,
    "fake_medical_id": medical_id,
    "fake_ipv4": ipv4,
    "fake_company": company,
    "partial_mask": partial,
    "shuffle_chars": shuffle,
    "replace_digits": replace_digits,
}
