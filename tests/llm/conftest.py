import random

import pytest

from tests.conftest import spark  # noqa: F401

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randint(0, 400)) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):  # noqa: F811
    """Nulls in every column, empty, blank, tiny and very long texts, ties, repeated rows, clashing further columns."""
    long = prose(1, 20_000)
    rows = [(1, None, "en", "a", 5), (2, "", "en", None, 0), (3, " \t\n ", None, "a", 4), (None, None, None, None, None), (4, "one", "en", "a", 3),
            (5, long, "en", "a", len(long)), (6, long, "en", "b", len(long)), (7, prose(2, 60), "fr", "b", 1), (7, prose(2, 60), "fr", "b", 1),
            (None, prose(2, 60), "fr", "b", 1), (8, "é ß 漢字 🙂 x", "fr", "b", 9), (9, "!!! ??? 12 34", "en", "a", 1)]
    rows = [(*r, "mine", 1.5, 7, "t") for r in rows]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, score string, n_removed double, k int, t string")


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
