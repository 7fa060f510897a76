import pytest


@pytest.fixture(scope="session")
def frame(spark):
    def make(rows, schema="doc_id long, text string"):
        return spark.createDataFrame(rows, schema)

    return make


#: Null and empty texts, a null id, repeated rows, and an extra column that could clash with a working name.
ODD = [(0, "one two three four five six", "x"), (0, "one two three four five six", "x"), (1, None, "y"), (2, "", None), (None, "one two three four five six", "z"), (3, " \t\n", "w"), (4, "word " * 3000, "v"), (5, "é😀 ñ", "u")]
ODD_SCHEMA = "doc_id long, text string, id string"
