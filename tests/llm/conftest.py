import pytest


@pytest.fixture
def frame(spark):
    """Rows of doc_id and text, with a column whose name clashes with results."""

    def make(rows, parts=2):
        df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, kept string")
        return df.repartition(parts) if rows else df

    return make
