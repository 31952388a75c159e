"""Personal data inside free text: counting and consistent replacement."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkguard.functions import masks

# What counts as a card, a phone, an e-mail or an IPv4 address inside a text.
CARD = r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b"
PHONE = r"(?:\+\d{1,2} )?\(\d{3}\) ?\d{3}-?\d{4}|\b\d{3}-\d{3}-\d{4}\b"
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"

# name, what every match holds (a cheap look before the search), pattern, mask
KINDS = [
    ("card", r"\d{4}[- ]?\d{4}", CARD, masks.credit_card),
    ("phone", r"\d{3}[)-]", PHONE, masks.phone),
    ("email", "@", EMAIL, masks.email),
    ("ip", r"\d\.\d", IP, masks.ipv4),
]
# Without these letters a text has no match of any kind.
NEEDED = "[0-9@]"


def _cut(text: Column, kind: int, sign: str, pattern: str, mask: masks.Mask, key: str, column: str) -> Column:
    """A piece of text as pieces between its matches (kind 0) and masked matches, in order."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def side_by_side(piece: Column, match: Column) -> Column:
        return F.array(_piece(0, piece), _piece(kind, mask(match, key, column)))

    pieces = F.filter(F.flatten(F.zip_with(between, found, side_by_side)), lambda x: x["s"].isNotNull())
    return F.when(text.rlike(sign), pieces).otherwise(F.array(_piece(0, text)))


def _piece(kind: int, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), text.alias("s"))


def masked_pieces(text: Column, key: str, column: str) -> Column:
    """The text cut at the borders of its matches, which are masked; kinds in turn, and none looks into another's mask."""

    def cut(kind: int, sign: str, pattern: str, mask: masks.Mask):
        return lambda x: F.when(x["kind"] == 0, _cut(x["s"], kind, sign, pattern, mask, key, column)).otherwise(F.array(x))

    whole = out = F.when(text.isNotNull(), F.array(_piece(0, text)))
    for kind, (_, sign, pattern, mask) in enumerate(KINDS, 1):
        out = F.flatten(F.transform(out, cut(kind, sign, pattern, mask)))
    return F.when(text.rlike(NEEDED), out).otherwise(whole)
