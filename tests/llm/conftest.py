import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def corpus(spark):
    """Documents with every awkward kind: null, empty, blank, very long, repeated rows, odd characters."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog " * 3, "en", "a", 1),
        (2, "the quick brown fox jumps over the lazy dog " * 3, "en", "a", 1),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (5, " \t\n ", "fr", "b", 4),
        (6, "one", "de", "b", 3),
        (7, "one two three", "de", "c", 3),
        (8, "don't l'été 日本語 <|endoftext|>  two  spaces\n\n\nit's\tTHE End ", "de", "c", 3),
        (9, " ".join(f"w{i % 977}x{i}" for i in range(30000)), "en", "a", 200000),
        (9, " ".join(f"w{i % 977}x{i}" for i in range(30000)), "en", "a", 200000),
        (10, "the the the the the the the the the", "en", None, 9),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def nothing(corpus):
    return corpus.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
