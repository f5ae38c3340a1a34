import pytest

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def folder():
    import os

    if not os.path.isdir(FOLDER):
        pytest.skip("no test data here")
    return FOLDER


@pytest.fixture(scope="session")
def documents(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang", "source").collect()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls anywhere, empty and blank texts, ties, repeated rows, columns with clashing names."""
    kind = "doc_id long, text string, lang string, source string, n_chars long, size long, row long, label string"
    long_text = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    return spark.createDataFrame(
        [
            (1, "a b c d e f g h", "en", "s", 1, 1, 1, "x"),
            (1, "a b c d e f g h", "en", "s", 1, 1, 1, "x"),
            (2, "a b c  d e f g h", None, None, None, None, None, None),
            (3, None, "en", "s", None, None, None, None),
            (4, "", "fr", "t", 0, 0, 0, ""),
            (5, " \n\t ", "fr", "t", 4, 0, 0, ""),
            (None, "a b c d e f g h", "en", None, 1, 1, 1, "x"),
            (None, None, None, None, None, None, None, None),
            (6, long_text, "en", "s", 1, 1, 1, "y"),
            (7, long_text + " tail", "en", "u", 1, 1, 1, "y"),
            (8, "x" * 300_000, "en", "u", 1, 1, 1, "y"),
            (9, "Released under the MIT License. 123 é中\U0001f600 <|endoftext|> don't", "en", "u", 1, 1, 1, "y"),
            (6, "another text under a known id", "en", "s", 1, 1, 1, "y"),
        ],
        kind,
    )


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
