import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
    T.StructField("size", T.StringType()), T.StructField("kept", T.BooleanType()),
])


@pytest.fixture(scope="session")
def documents(spark):
    """Documents from (doc_id, text[, lang[, source]]) rows, with columns whose names operators use themselves."""
    def make(rows, parts=3):
        full = []
        for row in rows:
            doc_id, text, lang, source = (*row, None, None)[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text), "s", "z", None))
        frame = spark.createDataFrame(full, DOCUMENTS)
        return frame.repartition(parts) if full else frame

    return make


@pytest.fixture(scope="session")
def edges():
    """Nulls, empty and blank texts, repeated rows, signs only, a long text without white space and one of many words."""
    return [
        (1, None, None, None), (2, "", "en", "a"), (3, " \t\n\x0b\f\r ", "en", "a"), (4, "one", "en", None), (5, "one", "de", "b"),
        (6, "12 ?! 34", None, "b"), (7, "x" * 20_000, "en", "c"), (8, "wort und " * 5_000, "de", "c"), (9, "ein Wort und noch eins", "de", "a"),
        (9, "ein Wort und noch eins", "de", "a"), (None, "ein Wort und noch eins", "de", "a"), (10, "émile à l'école ñ 中文", "fr", "é"),
        (-3, "one two three four five six seven eight nine ten", "en", "a"), (11, "a  b\x00c", "en", "a"),
    ]
