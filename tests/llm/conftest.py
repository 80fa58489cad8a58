import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


def prose(rng: random.Random, words: int, syllables=("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha")) -> str:
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, repeated rows and ids, one long text, copies."""
    rng = random.Random(5)
    base = prose(rng, 300)
    near = base.split(" ")
    near[150] = "changed"
    long_ = prose(rng, 40_000)
    passage = prose(rng, 90)
    rows = [
        (1, base, "en", "a", 10),
        (2, base, "en", "a", 10),
        (3, " ".join(near), "en", None, None),
        (4, None, "en", "a", None),
        (5, "", "en", "a", 0),
        (6, " \t\n ", None, "a", 4),
        (7, "one two three", "fr", "b", 13),
        (7, "one two three", "fr", "b", 13),
        (8, "one two three", "fr", "b", 13),
        (None, "nobody knows this text at all or where it is from", "en", "a", None),
        (None, None, None, None, None),
        (9, prose(rng, 60) + " " + passage + "\n" + prose(rng, 50), "en", "a", 5),
        (10, passage + "  " + prose(rng, 70), "de", "a", 5),
        (11, "word " * 500, "en", "a", 5),
        (12, long_, "en", "a", 5),
        (13, "ünïcödé ẞ 中文 🙂 " * 40 + prose(rng, 30), "en", "a", 5),
        (14, prose(rng, 300), "en", "a", 5),
        (14, prose(rng, 300), "en", "a", 5),
        (-3, passage, "en", "a", 5),
    ]
    return rows


#: Names that operators use inside themselves.
CLASHES = ("id", "doc", "mark", "label", "score", "held_out", "sid", "path", "n", "spans", "x", "piece", "start", "length", "offset", "packed", "gram", "_text", "own", "kept", "sample_id")


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows, SCHEMA)
    return df.select("*", *[F.lit(f"clash {c}").alias(c) for c in CLASHES])


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, i % 3 % 2) for i in range(1, 15)] + [(None, 1, None), (3, 1, 1)], "doc_id long, quality int, toxic int")
