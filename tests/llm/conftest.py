import pytest


@pytest.fixture
def documents(spark, tmp_path):
    """A table of documents, read from files: (doc_id, text, lang, source, n_chars)."""

    def make(rows, name="documents"):
        rows = [(*r, *(["en", "s"][len(r) - 2 :])) for r in rows]
        kinds = "doc_id bigint, text string, lang string, source string"
        path = str(tmp_path / name)
        df = spark.createDataFrame(rows, kinds)
        df.selectExpr("*", "cast(length(text) as bigint) as n_chars").write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return make
