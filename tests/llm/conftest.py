"""Shared inputs of the corpus-preparation tests (the session comes from tests/conftest.py)."""

import random

import pytest

SYLLABLES = "ba do ki lu me no pa re si tu va wo xe zi fa ge".split()


@pytest.fixture(scope="session")
def prose():
    """A function making invented prose: prose(seed, words)."""
    def make(seed, n):
        r = random.Random(seed)
        return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_rows(prose):
    """Documents with nulls, empty and very long texts, repeated rows and other alphabets."""
    return [(1, None), (2, ""), (3, "one two"), (4, prose(4, 60)), (4, prose(4, 60)), (5, prose(5, 6000)), (6, "日本語 テキスト 🙂 é ½ <|endoftext|> end  \n\t x"), (7, "same same " * 400), (8, prose(4, 60)), (None, prose(9, 80)), (10, " \n ")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """As a table, with extra columns whose names operators use inside."""
    rows = [(i, t, "en", "s", len(t or ""), 1, "x", 2.0) for i, t in odd_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part int, role string, score double")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
