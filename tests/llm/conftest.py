import pytest


@pytest.fixture
def frame(spark):
    """Rows as a frame of the documents' columns, with extra columns that clash with results."""

    def make(rows, schema="doc_id bigint, text string, lang string, source string, n_chars bigint"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, schema)
        return df.withColumns({"n_words": F.lit("x"), "id": F.lit("y"), "kept": F.lit("z")})

    return make
