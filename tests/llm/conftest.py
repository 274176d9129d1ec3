import pytest

from vacantia.llm.queries import byte_vocabulary, piece_vocabulary

# Columns that the operators might use as names of their own.
CLASHING = ("n_words", "print", "node", "h", "text_key", "rank", "length", "lost", "kept", "bound")


@pytest.fixture
def make_documents(spark):
    """Documents of (doc_id, text) or (doc_id, text, lang), with extra columns of clashing names."""

    def make(rows, partitions=3):
        full = [
            (row[0], row[1], row[2] if len(row) > 2 else "en", "s", len(row[1] or ""), *["x"] * len(CLASHING))
            for row in rows
        ]
        schema = "doc_id long, text string, lang string, source string, n_chars long, "
        schema += ", ".join(f"`{name}` string" for name in CLASHING)
        return spark.createDataFrame(full, schema).repartition(partitions)

    return make


@pytest.fixture(scope="session")
def vocabularies():
    return byte_vocabulary(), piece_vocabulary()


EDGE_ROWS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (4, "one"), (None, "a row without an id"),
    (None, None), (5, "word " * 30_000), (6, "x" * 200_000), (7, "é ß \U0001f600 漢字 \x1c\xa0 ok"),
]
