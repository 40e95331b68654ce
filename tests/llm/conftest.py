import pytest


@pytest.fixture()
def table(spark):
    """A table of documents: rows of (doc_id, text) with columns that clash with names used inside."""

    def make(rows, source="web"):
        full = [(i, t, "en", s, 0, "x", 7, "y") for i, t, s in ((*r, source)[:3] if len(r) == 2 else r for r in rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, row string, size long, mark string").repartition(3)

    return make


@pytest.fixture()
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


#: Null, empty, blank, ties, repeated rows, a null id, one long text.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four five"), (4, "one two three four five"), (5, "one two three four five"), (None, "no id here at all"), (6, "word " * 30_000)]


@pytest.fixture()
def odd(table):
    return table(ODD)
