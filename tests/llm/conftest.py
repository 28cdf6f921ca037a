"""Hard rows for every operator: nulls, empty and long texts, ties, repeated rows, columns with operators' own names."""

import pytest

WORDS = "the quick brown fox jumps over the lazy dog while seven grey geese cross a cold river near old mills".split()


def prose(seed, n):
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice(("th", "er", "on", "an", "re", "en", "st", "ou")) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def hard(spark):
    """documents with extra columns that clash with names inside the operators."""
    texts = [None, "", " \t\n", "one", "A b C d e", prose(1, 400), prose(1, 400), prose(2, 90) + "\nTHE END\nTHE END\n", "x" * 60_000, "ab cd " * 9_000, "é ü ☃ 😀 " * 40, "\0 \x7f <|endoftext|> it's", prose(3, 3000)]
    rows = [(i if i else None, t, "en" if i % 2 else None, ("a", "b", None)[i % 3], len(t or ""), "k", i, "r") for i, t in enumerate(texts)]
    rows += [rows[5], rows[1], rows[0]]  # repeated rows
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, size int, row string")


@pytest.fixture(scope="session")
def none(hard):
    return hard.where("false")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 0, 1), (2, None, None), (None, 1, 0), (5, 1, 0), (5, 1, 0), (6, 7, 9), (7, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
