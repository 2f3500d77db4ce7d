import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
BIG = (1 << 60) + 1


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    parts = ["ta", "re", "mi", "lon", "ver", "qui", "sho", "an", "del", "u"]
    return " ".join("".join(draw.choice(parts) for _ in range(draw.randint(1, 4))) for _ in range(words))


def hard_rows() -> list[tuple]:
    """Nulls in every column, empty, blank, very long and repeated texts, repeated rows, ids beyond 2**53."""
    passage = prose(1, 90)
    rows = [
        (1, prose(2, 120) + " " + passage, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0),
        (4, " \t\n", "en", "b", 3), (5, "one two", "en", "b", 7), (6, prose(3, 40) + "\n" + passage + " tail end", "de", None, 9),
        (7, prose(4, 30_000), "en", "a", None), (8, prose(2, 120) + " " + passage, "en", "a", 1),
        (8, prose(2, 120) + " " + passage, "en", "a", 1), (None, "a text without an id " + passage, "en", "c", 2),
        (BIG, "<|endoftext|> not a separator # é ß   𝄞", "xx", "c", 5), (-3, prose(5, 1500), "fr", "b", 4),
        (12, passage, "en", "a", 3),
    ]
    return rows + [(100 + n, prose(100 + n, 60 + n), "en", "a" if n % 3 else "b", n) for n in range(40)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(hard_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def wide_docs(docs):
    """The same rows with columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    names = ("mark", "key", "base", "tokens", "sketch", "score", "row", "grams", "bucket", "slot", "place", "kept",
             "component_id", "fingerprint", "label", "word", "_order", "_spans")
    return docs.select("*", *[F.lit("x").alias(n) for n in names])


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
