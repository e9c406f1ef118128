import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents of ``{doc_id: text}`` or ``(doc_id, text)`` pairs."""

    def make(texts):
        pairs = texts.items() if isinstance(texts, dict) else texts
        rows = [(i, t, "en", "s", len(t or "")) for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA)

    return make


LONG = "word " * 30_000 + "end"

EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one"),
    (5, "The same Text stands here again and again"),
    (6, "the same text stands here again and again"),
    (6, "the same text stands here again and again"),
    (7, LONG),
    (8, "ß中\U0001f600 <|endoftext|>  two  spaces\x00nul"),
    (None, "a row without any number of its own"),
]
