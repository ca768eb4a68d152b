import pytest

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{k % 977}" for k in range(60_000))
EDGES = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "one"), (5, "Plain words in a line.\nAnd a second line."),
    (6, "Plain words in a line.\nAnd a second line."), (7, LONG), (8, "日本語 テスト 😀"), (9, "12345 67890 !!!"),
    (10, "<|endoftext|> token=abc it's  two  blanks\r\n"), (10, "another text under the same id"), (None, "a text without an id"),
    (11, "same row"), (11, "same row"),
]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(EDGES, "doc_id long, text string")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")


@pytest.fixture
def odd_columns(spark):
    """Documents with columns whose names operators use themselves."""
    rows = [(k, t, "en", "s", 0, "x", 1.5, "y", 7) for k, t in EDGES]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "lang_pred string, score double, removed string, n_tokens int")


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(small_docs):
    return {r.doc_id: r.text for r in small_docs.collect()}
