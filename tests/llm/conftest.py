import pytest

DOCS = "doc_id long, text string"


@pytest.fixture(autouse=True)
def shipped(spark):
    from postpulse.llm.common import ship_package
    ship_package(spark)


@pytest.fixture
def docs(spark):
    """(doc_id, text) rows, with extra columns whose names the operators use themselves."""
    def make(rows):
        from pyspark.sql import functions as F
        df = spark.createDataFrame(rows, DOCS)
        return df.select("doc_id", "text", *[F.lit("x").alias(c) for c in (
            "rid", "key", "kept", "n_words", "digest", "runs", "row", "file", "cls", "starts",
            "words", "items", "n", "lang_pred", "bin_id")])
    return make
