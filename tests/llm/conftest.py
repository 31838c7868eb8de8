import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, label string, score double"


@pytest.fixture(scope="session")
def docs(spark):
    """Makes documents from (doc_id, text) pairs, with further columns whose names operators use inside."""

    def make(*rows):
        full = [(i, t, "en" if k % 3 else None, f"s{k % 2}" if k % 5 else None, None if t is None else len(t), 7, "x", None) for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS)

    return make
