import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in ("score", "fp", "f0", "key", "node", "label", "_gone", "_row", "_chunk", "n_removed", "kept_text", "bucket", "length", "_slice", "_rank", "words")]
)
LONG = "word salad " * 4000


def doc(i, text, lang="en"):
    return (i, text, lang, None, None, *["x"] * (len(SCHEMA) - 5))


@pytest.fixture
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    base = "the quick brown fox jumps over the lazy dog near the river bank today and again tomorrow at noon with friends\nsecond line here too"
    rows = [doc(1, base), doc(2, base), doc(2, base), doc(3, None), doc(4, ""), doc(5, "  \n\t "), doc(6, LONG), doc(7, "x" * 5000), doc(None, base), doc(8, "one"), doc(9, base + " changed", None), doc(10, "é日本語 ünï " * 30)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
