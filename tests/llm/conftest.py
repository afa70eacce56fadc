import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def make(spark):
    def run(rows, schema=SCHEMA):
        """rows of (doc_id, text[, source])"""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, schema)

    return run


@pytest.fixture(scope="session")
def odd(make):
    """Null and repeated ids, null, empty and very long texts, null sources."""
    return make([(None, "a null id"), (1, None, None), (2, ""), (2, ""), (3, "word " * 30000), (4, "same text here now yes"), (4, "same text here now yes"), (5, "ünï côdé \U0001f600 text"), (6, "x"), (7, "   \n\t")])


@pytest.fixture(scope="session")
def none(make):
    return make([])
