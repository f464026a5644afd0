"""Small tables for the training-data operators."""

from __future__ import annotations

import random

SYLLABLES = ["an", "er", "tion", "ou", "re", "st", "ble", "ing", "le", "ch", "ê", "ß"]


def prose(r: random.Random, words: int) -> str:
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.choice([1, 2, 2, 3]))) for _ in range(words))


def documents(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def odd_rows() -> list[tuple]:
    """Null and empty texts, a null id, repeated rows, one long text."""
    r = random.Random(1)
    long = prose(r, 30_000)
    return [(1, None), (2, ""), (3, " \n\t"), (None, "no id here"), (4, "the same"), (4, "the same"), (5, long), (6, "ünïcödé ☃ 𝒳")]
