import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "lorem " * 30_000


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text[, source]) rows."""

    def run(rows, extra=""):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *r[3:]) for r in rows]
        return spark.createDataFrame(full, DOCS + extra).repartition(3)

    return run


@pytest.fixture(scope="session")
def odd(make):
    """Nulls, empty and blank texts, a very long one, repeated rows and ids."""
    return make([(1, None), (2, ""), (3, " \t\n"), (4, LONG), (5, "a b c"), (5, "a b c"), (5, "other words here"), (None, "null id text"), (7, "Zürich ▁ 日本 😀 end", None)])


@pytest.fixture(scope="session")
def empty(make):
    return make([])
