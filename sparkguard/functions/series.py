"""Names of series and matching of labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def series_key(name: Column, tags: Column) -> Column:
    """``name`` or ``name:k=v,...`` with the tags sorted by key."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(tags)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return F.when(F.coalesce(F.size(tags), F.lit(0)) > 0, F.concat(name, F.lit(":"), pairs)).otherwise(name)


def key_of(name: str, tags: dict[str, str] | None = None) -> str:
    """The same key for literals."""
    return name + (":" + ",".join(f"{k}={v}" for k, v in sorted(tags.items())) if tags else "")


def label_equals(labels: Column, **wanted: str) -> Column:
    hit = F.lit(True)
    for k, v in wanted.items():
        hit = hit & F.coalesce(labels[k] == v, F.lit(v == ""))
    return hit


def label_matches(labels: Column, **patterns: str) -> Column:
    """Regular expressions on labels are anchored at both ends."""
    hit = F.lit(True)
    for k, p in patterns.items():
        hit = hit & F.coalesce(labels[k], F.lit("")).rlike(f"^(?:{p})$")
    return hit


def mapped_value(value: Column, texts: dict[float, str]) -> Column:
    cases = None
    for v, text in texts.items():
        cases = F.when(value == v, text) if cases is None else cases.when(value == v, text)
    return cases


def threshold_colour(value: Column, steps: list[tuple[float | None, str]]) -> Column:
    """Colour of the highest step that the value reaches; the first step has no bound."""
    cases = F.lit(steps[0][1])
    for bound, colour in steps[1:]:
        cases = F.when(value >= bound, colour).otherwise(cases)
    return cases
