import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(4000)]


@pytest.fixture(scope="session")
def odd_rows(words):
    """Null and empty texts, ties, repeats, a long text, null and repeated ids."""
    rng = random.Random(9)
    long = " ".join(rng.choice(words) for _ in range(30_000))
    base = " ".join(rng.choice(words) for _ in range(80))
    rows = [(1, base), (2, base.replace(" ", "\n\t ")), (3, base), (3, base), (4, None), (5, ""), (6, "  \n"), (7, long), (8, base + " tail"), (None, base), (None, None), (9, "Ünïcode ÀÉ x"), (9, "other text"), (10, "one")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "en", "s1", 7, "x", 1.0) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, keep_id string, score double")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
