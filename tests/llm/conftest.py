import pytest

#: Columns whose names the operators use themselves: they must not clash.
EXTRA = "id long, size string, th int, fp string, component string, pattern int, score string, key int, label int, lines int, range int"


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents-like frame from (doc_id, text, source) with clashing extra columns."""
    def make(rows):
        schema = f"doc_id long, text string, lang string, source string, n_chars long, {EXTRA}"
        extra = (7, "x", 1, "y", "z", 2, "s", 3, 4, 5, 6)
        data = [(i, t, None, s, None if t is None else len(t), *extra) for i, t, s in rows]
        return spark.createDataFrame(data, schema)
    return make


@pytest.fixture(scope="session")
def odd_docs(make_docs):
    """Null and empty texts, null ids and sources, ties, repeated rows, a very long text."""
    words = " ".join(f"word{i % 977} alpha{i % 13}" for i in range(60_000))
    return make_docs([
        (1, None, "a"), (2, "", "a"), (3, " \t\n ", None), (4, "one", "b"), (5, "one two", "b"),
        (6, "The quick brown fox jumps over the lazy dog again and again", "c"),
        (7, "the QUICK brown fox jumps over the lazy dog again and again", "c"),
        (7, "the QUICK brown fox jumps over the lazy dog again and again", "c"),
        (None, "a row without an id", None), (None, None, "a"),
        (9, "Éclair über naïve ÉCLAIR\nline two is here\nline two is here\n", "d"),
        (10, "LINE TWO IS HERE  \n\nlast", "d"), (11, words, "a"), (12, "x" * 300_000, "b"),
    ])


@pytest.fixture(scope="session")
def no_docs(make_docs):
    return make_docs([])
