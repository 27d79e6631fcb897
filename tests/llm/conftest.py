import random

import pytest

WORDS = "river stone light winter garden copper window silver morning paper forest bridge candle harbour meadow".split()

#: Columns whose names the operators use themselves.
EXTRA = "row_at string, ID string, size string, kept long, shard string, node string, key string, block string, lang_pred string, score string"


def sentence(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls everywhere, empty and very long texts, copies, repeated rows, repeated ids, and clashing column names."""
    near = sentence(1, 60)
    long = sentence(2, 40_000)
    rows = [
        (1, sentence(1, 60), "en", "a"), (2, near + " end", "en", "a"), (3, near, "en", None), (3, near, "en", None),
        (4, None, None, "b"), (5, "", "en", "b"), (6, " \t\n ", None, None), (7, long, "fr", "a"), (8, long + " x", "fr", "c"),
        (None, None, None, None), (None, near, "en", "b"), (9, "one two", "en", ""), (10, "one two", "fr", ""), (10, "éè ß \U0001f600 中文", None, "c"),
        (11, "<|endoftext|> a  <|startoftext|>\x1cb \xa0 c  d", "en", "c"), (12, "12 34 !!", "en", "d"), (12, sentence(3, 30), "fr", "d"),
    ]
    schema = f"doc_id long, text string, lang string, source string, {EXTRA}"
    extra = ("x", "y", None, 7, "z", None, "k", None, "w", "s")
    return spark.createDataFrame([r + extra for r in rows], schema)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    """The documents of the smallest tables, as plain rows."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
