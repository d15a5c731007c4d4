"""Small tables with the cases that every operator must stand."""

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows):
    """Rows of (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], SCHEMA)


def empty(spark):
    return documents(spark, [])


def prose(seed, n, words="the of and to in is that for it as was on be by this have from or had not but what all "
                        "were when we there can an your which their said if do will each about how up out them".split()):
    draw = random.Random(seed)
    return " ".join(draw.choice(words) + (draw.choice(words) if draw.random() < 0.5 else "") for _ in range(n))


def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows and ids."""
    long = prose(1, 30_000)
    return [(1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (None, "no id here", "b"), (None, None, None),
            (4, long, "a"), (5, long + " end", "a"), (6, "word", "b"), (7, "two words", "b"), (8, "a b c", "b"),
            (9, "same row", "c"), (9, "same row", "c"), (9, "same row", "c"), (9, "other text of one id", "c"),
            (10, "é" * 400 + "\n" + "ß ü", None), (11, prose(2, 200), "a"), (12, prose(2, 200), "c"),
            (13, "x" * 5000, "b"), (14, prose(3, 120) + "\r\n" + prose(3, 60), "a")]


def odd(spark):
    """With columns whose names operators use themselves."""
    names = ["_part", "_id", "key", "hash", "host", "path", "own", "size", "copies", "copy", "origin", "item", "row",
             "fingerprint", "component_id", "text_hash", "target", "words", "kept", "n", "a.b"]
    return documents(spark, odd_rows()).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


def plain_words(text):
    return (text or "").encode().split()
