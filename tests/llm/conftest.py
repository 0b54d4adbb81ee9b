import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts, or from (id, text, source) rows."""

    def make(rows, schema=DOCS):
        full = []
        for i, row in enumerate(rows):
            doc_id, text, source = row if isinstance(row, tuple) else (i, row, "a")
            full.append((doc_id, text, "en", source, len(text or "")))
        return spark.createDataFrame(full, schema)

    return make


@pytest.fixture(scope="session")
def words():
    """Deterministic words that hardly repeat."""
    import random

    rnd = random.Random(7)

    def make(n, seed=None):
        r = random.Random(seed) if seed is not None else rnd
        return [f"{r.choice('bcdfgh')}{r.choice('aeiou')}{r.randint(0, 99999)}" for _ in range(n)]

    return make
