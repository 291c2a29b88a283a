import random

import pytest

ODD_SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "key_a long, row_id string, size int, part string, score double, label int"
)


def odd(doc_id, text, lang="en", source="s", n_chars=1):
    """A row with extra columns whose names the operators use themselves."""
    return (doc_id, text, lang, source, n_chars, 7, "x", 3, "p", 0.5, 9)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and blank texts, a long one, repeated rows, equal ids."""
    base = prose(1, 300)
    rows = [
        odd(1, base), odd(1, base), odd(2, base + "  "), odd(3, base, None, None, None),
        odd(None, base), odd(None, None, None, None, None), odd(4, None), odd(5, ""),
        odd(6, " \t\n"), odd(6, " \t\n"), odd(7, prose(2, 60_000)), odd(8, "one"),
        odd(9, "one two three four"), odd(9, "another text of the same id, yes"),
        odd(10, "Größe naïve \U0001f642 tail", "de", "t"), odd(11, prose(3, 50), "fr", "u"),
        odd(12, " ".join([*base.split()[:-3], "x", "y", "z"]), "en", "u"),
    ]
    return spark.createDataFrame(rows, ODD_SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
