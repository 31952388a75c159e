"""Keyed digests: every random-looking draw of the library is a slice of one.

The same (key, column, value) gives the same digest on every executor and in every run, which is how
a mask stays consistent without a shared cache. ``md5`` spreads values; where the digest itself is
published (hash and key masks) SHA-256 is used.
"""

from __future__ import annotations

import hmac

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_key(key: str, column: str) -> str:
    """The key of one column, derived on the driver, so that no plan holds the secret itself."""
    return hmac.new(key.encode(), column.encode(), "sha256").hexdigest()[:32]


def keyed_text(value: Column, key: str, column: str) -> Column:
    """Null for a null value, so that every mask built on it keeps nulls by itself."""
    return F.concat(F.lit(f"{column_key(key, column)}:"), value)


def digest(value: Column, key: str, column: str) -> Column:
    return F.md5(keyed_text(value, key, column).cast("binary"))


def strong_digest(value: Column, key: str, column: str) -> Column:
    return F.sha2(keyed_text(value, key, column).cast("binary"), 256)


def slot(hex_text: Column, i: int) -> Column:
    """The i-th 32-bit slice (0..3) of a digest as a non-negative long."""
    return F.conv(F.substring(hex_text, 1 + 8 * i, 8), 16, 10).cast("long")


def fraction(hex_text: Column, i: int = 0) -> Column:
    """The i-th slice as a double in [0, 1)."""
    return slot(hex_text, i).cast("double") / F.lit(4294967296.0)


def supply(hex_text: Column, length: Column) -> Column:
    """At least ``length`` hex characters, by chaining block numbers onto the digest."""
    blocks = F.sequence(F.lit(0), F.floor(length / 32).cast("int"))
    chained = F.transform(blocks, lambda b: F.md5(F.concat(hex_text, F.lit(":"), b.cast("string")).cast("binary")))
    return F.array_join(chained, "")


def digit_supply(hex_text: Column, length: Column) -> Column:
    """As ``supply`` with every hex character taken modulo ten."""
    return F.translate(supply(hex_text, length), "abcdef", "012345")
