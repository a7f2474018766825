import pytest


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) pairs, with columns whose names could clash."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, key long, fp string, hash int, root string"
        return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 2, "y") for i, t in rows], schema)

    return make
