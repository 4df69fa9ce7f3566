"""Small tables with the odd cases that every operator must bear."""

from __future__ import annotations

import random
import zlib

LONG = " ".join(f"wort{i % 977}" for i in range(40_000))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, SCORE2 string, held_out string"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def odd_rows():
    """Null and empty columns, a very long text, repeated rows, one id with two texts."""
    return [
        (None, "a text without an id that has some words", None), (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, LONG, "de"),
        (5, "the same row stands here twice and says so", "en"), (5, "the same row stands here twice and says so", "en"),
        (6, "one id with a first text of some words", "en"), (6, "one id with quite another text of words", "en"), (7, "12345 !!! ---", "en"), (8, "é", "fr"),
    ]


def prose(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


def part(doc_id: int, parts: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % parts


def clashing(df):
    """Columns that an operator might want to name its own, in any case."""
    from pyspark.sql import functions as F

    for name in ("score", "Node", "component_id", "held_out", "own_id", "own_hash", "ids", "tokens", "part", "n_tokens", "key"):
        df = df.withColumn(name, F.lit("mine"))
    return df
