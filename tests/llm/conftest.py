import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

ODD = [None, "", " ", "\n\n", "word", "a b c d e f g h " * 12, "zwei Wörter ñ 漢字 🙂 " * 3, "x" * 5000, "same line here\n" * 30, "Same text twice.", "Same text twice."]


@pytest.fixture(scope="session")
def make(spark):
    def build(texts, **extra):
        docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], DOCS)
        return docs

    return build


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """Writes a folder that looks like the given tables."""

    def build(**tables):
        root = tmp_path_factory.mktemp("tables")
        for name, df in tables.items():
            df.write.parquet(f"{root}/{name}.parquet")
        return str(root)

    return build
