import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, lang) rows, with a clashing extra column."""

    def make(rows):
        full = [(*r, *(["en"] if len(r) == 2 else []), "src", len(r[1] or "")) for r in rows]
        return spark.createDataFrame([(*r, 1, 2) for r in full], DOCS + ", id long, n int")

    return make
