import pytest


@pytest.fixture
def docs(spark):
    """Frame of (doc_id, text) rows, with a column whose name clashes with results."""

    def make(rows):
        return spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, fp string, id string")

    return make
