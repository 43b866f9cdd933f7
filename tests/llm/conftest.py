import pytest

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


@pytest.fixture
def documents(spark):
    """Rows of (doc_id, text) as documents, with columns whose names the operators use inside."""

    def make(rows, source="s"):
        from pyspark.sql import functions as F

        df = spark.createDataFrame([(i, t, "en", source if not callable(source) else source(i), len(t or "")) for i, t in rows], DOCS)
        return df.withColumns({c: F.lit("x") for c in ("key", "h1", "part", "row", "size", "class", "component", "words", "rate", "label")})

    return make


EDGES = [(1, None), (2, ""), (3, " \t\n"), (None, "no id here at all, but some words"), (4, "one"), (5, "one"), (5, "one"), (6, "é" * 3000), (7, "word " * 4000)]


@pytest.fixture
def edge_rows():
    """Nulls, empty and blank texts, repeated rows, a missing id, one very long word, one very long text."""
    return list(EDGES)
