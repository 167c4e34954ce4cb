import pytest


@pytest.fixture
def table(spark):
    """A documents-like table; extra columns bear the names that operators use inside."""

    def make(rows, extra=True):
        df = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        return df.selectExpr("doc_id", "text", "'x' AS rid", "1 AS n", "'y' AS h", "2 AS size", "'z' AS name", "3 AS bucket", "'en' AS lang", "4 AS label") if extra else df

    return make
