import pytest


@pytest.fixture
def docs(spark):
    """Rows to a documents table."""

    def make(rows, extra=False):
        df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        if extra:  # names that operators use themselves
            for c in ("id", "key", "score", "ids", "bag", "w", "n", "total", "media", "length", "piece", "size"):
                df = df.withColumn(c, df["n_chars"])
        return df

    return make
