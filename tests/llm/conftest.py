import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs_df(spark):
    """Documents from (doc_id, text) or fuller tuples; missing columns get defaults."""
    def make(rows):
        full = []
        for r in rows:
            doc_id, text = r[0], r[1]
            lang = r[2] if len(r) > 2 else "en"
            source = r[3] if len(r) > 3 else "src0"
            full.append((doc_id, text, lang, source, len(text or "")))
        return spark.createDataFrame(full, DOCS)
    return make
