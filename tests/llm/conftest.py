import pytest

#: Nulls, empties, one word, no letter, repeats, a long text without breaks, odd characters.
EDGE_TEXTS = [None, "", " ", "word", "!!! ???", "\n\n", "the cat sat on the mat " * 3, "the cat sat on the mat " * 3, "a" * 5000, "x  y\u0085z \U0001f600 é́", "\x00\x1f"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, "src", 1, 7) for i, t in enumerate(EDGE_TEXTS)]
    rows += [rows[6], rows[6]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans int").cache()


@pytest.fixture(scope="session")
def empty_docs(edge_docs):
    return edge_docs.limit(0)
