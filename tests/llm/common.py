"""Fixtures shared by the tests of the llm operators."""

from pyspark.sql import types as T

DOCS = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
)


def docs(spark, rows):
    """A documents table of (doc_id, text) rows."""
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOCS).repartition(3)


#: Null, empty and blank texts, repeated rows, a null id, an id with two texts, one very long word and a long text.
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one"), (4, "one"), (None, "a row without an id that still has words in it"), (5, "five words are in here"),
    (6, "x" * 40), (7, "é" * 10 + " Ünï 漢字 🙂 end."), (8, "long " * 3000), (9, "first of two texts here"), (9, "second of the two texts"), (-3, "negative id text here now"),
]
