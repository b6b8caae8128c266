import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Rows that every operator has to stand: null and empty texts, no words, repeats, ties, no id, very long, odd characters.
ROWS = [
    (1, None, "en", "s", None), (2, "", "en", None, 0), (3, " \t\n ", None, "s", 4), (4, "one", "en", "s", 3), (5, "one two", "en", "s", 7), (5, "one two", "en", "s", 7),
    (6, "The cat sat on the mat.\nThe cat sat on the mat.", "en", "s", 47), (7, "The cat sat on the mat.\nThe cat sat on the mat.", "de", "t", 47),
    (8, "<|endoftext|> \U0001f600 naïve İstanbul Straße ſ \x85 \xa0 café", "fr", "t", 40), (9, "word " * 30_000, "en", "s", 150_000), (10, "x" * 50_000, "en", "s", 50_000),
    (None, "no id here", "en", "s", 10), (11, "1234 5678 !!! ###", "es", "t", 17), (-3, "negative id", "es", "t", 11),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)


def tables(spark, tmp_path, **frames):
    """A folder with the given tables as Parquet."""
    for name, df in frames.items():
        df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)
