import pytest


@pytest.fixture
def docs(spark):
    """Make a documents table from texts (and sources)."""

    def make(texts, sources=None, ids=None):
        sources = sources or ["a"] * len(texts)
        ids = ids if ids is not None else range(len(texts))
        rows = [(i, t, "en", s, len(t or "")) for i, t, s in zip(ids, texts, sources)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make
