import pytest


@pytest.fixture
def docs(spark):
    """A maker of documents with the hard cases: nulls in every column, empty texts, repeated rows, extra columns of clashing names."""

    def make(texts, **extra):
        rows = [(i, t, "en", "src0" if i % 3 else None, len(t) if t is not None else None) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
        for name, value in extra.items():
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit(value))
        return df

    return make
