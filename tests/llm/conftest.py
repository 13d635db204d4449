import pytest

TEXTS = [
    (1, "Plain words stand here, one after the other, and they end.", "en"),
    (2, "Plain words stand here, one after the other, and they end.", "en"),
    (2, "Plain words stand here, one after the other, and they end.", "en"),
    (3, None, None),
    (4, "", "en"),
    (None, "A row without an id: naïve façade — 字 \x1c\xa0 x", "fr"),
    (None, None, None),
    (5, " \n\t  ", "en"),
    (6, "long" * 20_000 + " " + "word, " * 20_000, "en"),
    (7, 'api_key = "abc123def456" and AKIA' + "B7" * 10 + " and " + "0a1b2c3d" * 5 + " don't <|endoftext|>", "de"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, blank and long texts, repeated rows and ids, and columns with names that the operators use."""
    rows = [(i, t, lang, "src", None if t is None else len(t), 7, "mine", 1.5) for i, t, lang in TEXTS]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, n_tokens int, fp string, score double"
    ).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
