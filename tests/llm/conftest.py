import pytest

#: Cases that every operator must stand: nulls, empty and long texts, ties and repeated rows.
EDGE = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, " \n\t ", "en", None, 3),
    (4, "word " * 60_000, "en", "a", 300_000),
    (5, "same text here and there " * 9, "de", "b", 10),
    (6, "same text here and there " * 9, "de", "b", 10),
    (6, "same text here and there " * 9, "de", "b", 10),
    (7, "ünïcode 日本語 😀 <|im_end|> \x00 ok " * 8, "xx", "ü", 10),
    (None, "a row without a number " * 5, "en", "c", None),
    (8, "x" * 5000, "en", "c", 5000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge(spark):
    """The cases, with extra columns whose names operators may use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(EDGE, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("size", "blob", "fp", "part", "kind", "position", "ids", "salt", "node", "tag")})


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
