import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted string, bucket__ int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names clash with those that operators make."""

    def make(pairs, source="s"):
        return spark.createDataFrame([(i, t, "en", source, len(t or ""), 0.5, "x", 1) for i, t in pairs], DOCS)

    return make
