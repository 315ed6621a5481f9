import pytest

WIDE = "doc_id long, text string, source string, lang string, mix int, replaced string, row int, block int, text_sha256 string, score double"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and long texts, ties, repeated rows, clashing column names."""
    rows = [
        (1, "the same words stand here twice over", "a", "en", 1, "x", 1, 1, "z", 0.5),
        (2, "the same words stand here twice over", "a", "en", 1, "x", 1, 1, "z", 0.5),
        (2, "the same words stand here twice over", "a", "en", 1, "x", 1, 1, "z", 0.5),
        (3, None, None, None, None, None, None, None, None, None),
        (4, "", "b", "de", None, None, None, None, None, None),
        (5, " \n\t ", "b", "de", None, None, None, None, None, None),
        (None, "no id at all", "c", "fr", None, None, None, None, None, None),
        (7, "long " + "word and other words " * 30000, "c", "fr", None, None, None, None, None, None),
        (8, "one", None, "es", None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, WIDE)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], WIDE)


@pytest.fixture(scope="session")
def labels(spark, odd):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, None, None), (7, 0, 1)], "doc_id long, quality int, toxic int")
