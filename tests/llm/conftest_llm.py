import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use themselves.
        T.StructField("key", T.StringType()),
        T.StructField("rep", T.StringType()),
        T.StructField("score", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents with further columns whose names clash."""

    def make(*rows):
        full = [(i, t, None, None, None if t is None else len(t), "k", "r", "s") for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make


#: Texts every operator must stand: NULL and empty, odd blanks, repeats, long words.
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t "),
    (4, "one"),
    (5, "a  b\n c d 's <|endoftext|> 12345 日本語 ñ"),
    (6, "La " * 700),
    (7, "x" * 30_000),
    (8, "La " * 650),
    (9, "a  b\n c d 's <|endoftext|> 12345 日本語 ñ"),
    (None, "no id at all"),
    (10, "!?" * 50 + " end"),
]
