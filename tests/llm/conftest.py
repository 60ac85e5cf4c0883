import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark):
    """documents from (doc_id, text) pairs, with extra columns whose names clash with those operators use inside."""
    def make(pairs):
        rows = [(i, t, "en", "s", len(t) if t else None, "x", 1, "y") for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + ", row string, id int, bucket string").repartition(3)
    return make
