import pytest


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that every operator must take: nulls anywhere, empty and repeated rows, ties, an extra column with a clashing name."""
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(6000))
    copy = " ".join(f"passage{i}" for i in range(70))
    rows = [
        (1, copy + " tail one", "en", "a", 5, "x"),
        (2, "head two " + copy, "en", "a", 5, "x"),
        (3, copy + " tail one", None, None, None, None),
        (3, copy + " tail one", None, None, None, None),
        (4, None, "en", "b", 1, "x"),
        (5, "", "de", None, 0, "x"),
        (6, " \t\n ", "de", "c", 3, "x"),
        (None, copy, "fr", "a", 5, "x"),
        (None, None, None, None, None, None),
        (7, long, "fr", "b", len(long), "x"),
        (8, long + " end", "fr", "b", len(long), "x"),
        (9, "é ß 漢字 🙂   x\x00y", "es", "c", 12, "x"),
        (10, "one", "es", "d", 3, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3).cache()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
