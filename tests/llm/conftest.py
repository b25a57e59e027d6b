import pytest

#: doc_id, text, lang, source, n_chars and further columns with clashing names.
KIND = "doc_id long, text string, lang string, source string, n_chars long, h long, key string, score double"


@pytest.fixture(scope="session")
def make(spark):
    """Rows of (doc_id, text[, lang[, source]]) as a documents table with extra columns."""

    def table(rows):
        full = []
        for r in rows:
            i, text, lang, source = (*r, *(None,) * (4 - len(r)))
            full.append((i, text, lang, source, None if text is None else len(text), 1, "k", 0.5))
        return spark.createDataFrame(full, KIND)

    return table


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty, blank, long, repeated and tied rows."""
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n ", "en", "a"), (None, "no id here", "en", "b"), (4, "x " * 30000, "en", "a"), (5, "Same words in this row.", "en", "a"), (5, "Same words in this row.", "en", "a"), (6, "Same words in this row.", "de", None), (7, "Größe ñandú 日本語 😀 ###", None, "b")]
