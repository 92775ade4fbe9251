import pytest

#: Names that operators use inside; a table may have them as columns of its own.
CLASHES = {"node": 1, "root": 2, "block": 3, "anchor": 4, "spans": "x", "_found": "y", "_id": 5, "_gone": 6, "_hit": 7, "_toxic": 8, "class_id": 9, "ids": "z", "digest": "d", "codes": "c"}


@pytest.fixture(scope="session")
def make_docs(spark):
    """A table of documents from (doc_id, text) rows, with columns of clashing names."""

    def make(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in CLASHES.items())
        return spark.createDataFrame([(i, t, None, None, None, *CLASHES.values()) for i, t in rows], schema)

    return make


EDGES = [(901, None), (902, ""), (903, " \n\t "), (904, "one two"), (904, "one two"), (905, "x" * 20_000), (906, "word " * 20_000), (907, "!!! ... ???"), (None, "an id is missing here for this one"), (908, "é ß İ 日本語 😀  \x00 end")]
