import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, node long, key string"


@pytest.fixture
def docs(spark):
    """Builds a documents table from (doc_id, text[, lang, source]) rows, with extra columns whose names operators use inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1]), "x", 5, "k") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
