"""Small tables that hold every awkward case."""

from __future__ import annotations

import random

import pytest

#: Names that operators use inside; tables may have columns of the same names.
CLASHING = "score double, size long, fp long, shard int, spans string, length long, piece int, _row long, _id long, live string, whole string, component_id long, lang_pred string, n long"
DOC = "doc_id long, text string, lang string, source string, n_chars long, " + CLASHING


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(n))


def doc_row(i, text, lang="en", source="src1"):
    return (i, text, lang, source, None if text is None else len(text), 1.0, 2, 3, 4, "s", 5, 6, 7, 8, "l", "w", 9, "x", 10)


@pytest.fixture(scope="session")
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def odd_rows(rng):
    base = words(rng, 80)
    texts = [base, base, base.replace(" ", "  ", 1), None, "", " \n\t", "one", "ÄÖ ß ünï 漢字 🙂", words(rng, 30_000), "a" * 5_000, "1 2 3 4", words(rng, 5)]
    rows = [doc_row(i, t) for i, t in enumerate(texts)]
    return [*rows, doc_row(0, base), doc_row(None, "no id here at all"), doc_row(None, None, None, None), doc_row(50, base, None, None), doc_row(-7, "negative id")]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOC).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOC)
