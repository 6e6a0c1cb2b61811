import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table of texts, or of (doc_id, text)."""

    def make(rows):
        rows = [(i, t) if not isinstance(t, tuple) else t for i, t in enumerate(rows)]
        return spark.createDataFrame([(i, t, None, "s", None if t is None else len(t)) for i, t in rows], SCHEMA)

    return make


#: Texts that every operator must take: null, empty, white space, a tie, a repeat, odd characters, a very long one.
ODD = [None, "", " \n\t", "a", "a", "Ünï\x1c cödé 漢字 😀\x85\xa0end.", "word " * 6_000, "x" * 20_000, "1" * 2_000, "@" * 500, "a.b@c" * 300]
