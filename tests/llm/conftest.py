import pytest


@pytest.fixture(scope="session")
def table(spark):
    """Rows as a DataFrame, with columns that clash with names the operators use."""

    def make(rows, schema):
        df = spark.createDataFrame(rows, schema)
        for c in ("score", "fp", "row", "cuts", "id", "length", "hash"):
            if c not in df.columns:
                df = df.selectExpr("*", f"'x' AS {c}")
        return df

    return make
