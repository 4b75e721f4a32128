import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, ties, and columns whose names operators use inside."""
    long = " ".join(f"w{i % 977} x{i}" for i in range(30_000))
    prose = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows = [
        (1, prose, "en", "a", 1), (1, prose, "en", "a", 1), (2, "", "en", "a", 0), (3, None, "en", "b", None),
        (None, prose + " nu", None, None, None), (None, None, None, None, None), (4, long, "en", "b", 9), (5, " \n\t ", "de", None, 3),
        (6, "one\ntwo\nthree\nfour", "en", "c", 5), (7, "zero\none\ntwo\nthree", "en", "c", 5), (8, "x", None, "a", 1),
        (9, "<|endoftext|>it's  42 çé́ \x1c  Σ" * 3, "fr", "ü", 7),
    ]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F
    for name in ("size", "words", "hash", "fp", "comp", "seed", "pos", "kept", "host", "id", "path", "u", "v", "target", "copies"):
        df = df.withColumn(name, F.lit(name))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
