"""Small tables with every awkward case that the operators promise a result for."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

# The columns of documents, then names that operators might use themselves.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, size int, fp long, row string, taken int, score double, segment int, "
    "digest_own string, key_id long, key_digest long, least_row int, target double, part int, place string, label int, row_id long, piece int, length int"
)
_EXTRA = (1, 2, "r", 3, 0.5, 4, "d", 5, 6, 7, 8.0, 9, "p", 1, 10, 11, 12)


def words(n: int, seed: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 8))) for _ in range(n))


LONG = words(60_000, 5)
TEXTS: list[tuple[int | None, str | None, str | None]] = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \t\n ", None),
    (4, "Plain words in a row, plain words in a row.", "a"),
    (5, "plain  words\tin a row", "b"),
    (6, "plain words in a row", "b"),
    (7, "plain words in a row", "c"),
    (7, "plain words in a row", "c"),
    (None, "plain words in a row", None),
    (None, None, None),
    (8, LONG, "a"),
    (9, LONG + " tail", "a"),
    (10, "x", "b"),
    (11, "Ünïcödé ☃ \U0001f600 末 text\r\nwith\x0bbreaks", "c"),
    (12, words(300, 1), "a"),
    (12, words(300, 2), "a"),
    (13, words(300, 1) + " z", "b"),
    (14, "\n".join(words(30, k) for k in range(8)), "b"),
    (15, "start\n" + "\n".join(words(30, k) for k in range(2, 6)) + "\nend", "b"),
    (16, "123 456 !!! ---", "c"),
]


def documents(spark: SparkSession, rows=None) -> DataFrame:
    rows = TEXTS if rows is None else rows
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *_EXTRA) for i, t, s in rows], SCHEMA)


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def as_rows(df: DataFrame) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
