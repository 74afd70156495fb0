import pytest

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and extra columns whose names clash with the operators' own."""
    long = " ".join(f"word{i % 977} again{i % 13}" for i in range(40_000))
    rows = [
        (1, "the same line of text here now\nanother line stands right here today", "en", "a"),
        (2, "the same line of text here now\nanother line stands right here today", "en", "a"),
        (2, "the same line of text here now\nanother line stands right here today", "en", "a"),
        (3, None, None, None),
        (None, "a text without any number at all in it", "en", None),
        (None, None, None, None),
        (4, "", "en", "b"),
        (5, " \n\t\n ", "de", "b"),
        (6, long, "en", "a"),
        (7, "é́ 日本 <|endoftext|> İ \x00 'll 1½2", "fr", "c"),
        (2, "a second text of document two", "en", "a"),
    ]
    df = spark.createDataFrame([(*r, 1, "x", 2, "y", 9, "s") for r in rows], "doc_id long, text string, lang string, source string, n_lines int, rk string, slice int, kept string, side int, bucket string")
    return df


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
