import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, norm string, fp long, part int, run long, toxic_score double, leaks string, plain_text string, k1 long, kept_id long, ids string"


def long_text(seed: int, words: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(("th", "an", "er", "ing", "on", "re", "st")) for _ in range(rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty, white and very long texts, ties, repeated rows."""
    base = long_text(1, 300)
    texts = [base, base, base.replace(" ", "\n\t"), None, "", "  \x0b\n", "x", "É ß 漢字 Ωmega İ", "a" * 5000, "ab " * 4000, long_text(2, 20_000), base + " tail", "head " + base, long_text(3, 150), "one two", "ONE two", "#" * 700]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, base), (None, None), (3, None), (0, base), (0, base)]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    """The same as a table with further columns, named like those that operators use."""
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None, None, "n", 1, 2, 3, 0.5, "l", "p", 9, 8, "i") for k, (i, t) in enumerate(odd_rows)], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
