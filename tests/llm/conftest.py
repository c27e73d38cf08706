import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, sid long, score double"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rng = random.Random(3)
    base = words(rng, 120)
    parts = base.split()
    near = " ".join([*parts[:60], "other", *parts[61:]])
    texts = [None, "", "   \n\t ", "one", "One two three", base, base, near, words(rng, 30_000), "x" * 5_000, "é à ü " * 300, base + " " + words(rng, 150), "a\nb\na\n" * 30, "😀 <|im_end|> \\ <\\|"]
    rows = [(i, t, "en" if i % 2 else "fr", None if i == 3 else f"s{i % 3}", len(t or ""), 5, 0.5) for i, t in enumerate(texts)]
    return [*rows, rows[5], (None, base, None, None, None, None, None)]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3)


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
