import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, fp long, row string, stratum string, train boolean"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra columns with clashing names."""
    long_text = " ".join(f"wörd{i % 977}" for i in range(60_000))
    rows = [
        (1, None, "en", "s", 0, True, 1, "r", "x", False),
        (2, "", None, None, None, None, None, None, None, None),
        (3, " \n\t ", "de", "s", 4, False, 2, "r", "y", True),
        (4, long_text, "en", "s", len(long_text), True, 3, "r", "z", True),
        (5, long_text, "en", "s", len(long_text), True, 3, "r", "z", True),
        (6, "Mail bob@mail.example.com or +1 (988) 555-2485 now, twice: bob@mail.example.com", "fr", "s", 79, True, 4, "r", "z", True),
        (6, "Mail bob@mail.example.com or +1 (988) 555-2485 now, twice: bob@mail.example.com", "fr", "s", 79, True, 4, "r", "z", True),
        (None, "No id here at all but ten words to pass the rules", "es", "s", 49, True, 5, "r", "z", True),
        (7, "x" * 300_000, "en", "s", 300_000, True, 6, "r", "z", True),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 1, 0), (4, 1, 0), (5, None, 1), (None, 1, 0), (6, 0, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
