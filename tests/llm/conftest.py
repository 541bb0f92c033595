import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, hi string, n string, size string, key string"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts; extra columns have names that operators use inside."""

    def make(texts, langs=None, sources=None, ids=None):
        rows = []
        for i, t in enumerate(texts):
            rows.append((i if ids is None else ids[i], t, langs[i] if langs else "en", sources[i] if sources else f"src{i % 3}", len(t or ""), "x", "x", "x", "x"))
        return spark.createDataFrame(rows, DOCS)

    return make


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    return lambda n, r=rng: " ".join(r.choice(vocab) for _ in range(n))
