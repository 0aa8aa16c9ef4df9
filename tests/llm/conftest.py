import pytest

LONG = "word " * 60_000
REPEAT = "the same line of a text that is long enough to be seen twice in one collection of documents today"

#: (doc_id, text, lang, source, n_chars): nulls in every column, empty and long texts, ties and repeated rows.
ROWS = [
    (1, REPEAT, "en", "a", 98),
    (2, None, "en", "a", 0),
    (3, "", None, None, None),
    (4, REPEAT, "en", "b", 98),
    (4, REPEAT, "en", "b", 98),
    (5, LONG, "de", "a", len(LONG)),
    (6, " \t\n\x0b\x0c\r ", "de", "b", 7),
    (7, "Grüße ▁ 😀   x\x00y <|endoftext|> É", "de", None, 20),
    (None, "a text without an id", None, "c", None),
    (8, "short text\n\nshort text\n", "fr", "c", 23),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; a table may have columns so named.
CLASHES = ["row", "fp", "component_id", "kept_id", "text_key", "strong", "key_doc_id", "q_n_words", "tox_score", "copies", "target", "u", "w", "size", "ids", "start", "anchor", "spans", "label", "piece_ids"]


@pytest.fixture(scope="session")
def odd(spark):
    """The rows above with clashing extra columns."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit(f"own {c}") for c in CLASHES})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
