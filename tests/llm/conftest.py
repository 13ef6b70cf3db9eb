import datetime as dt

import pytest
from pyspark.sql import types as T

LONG = "".join(f"word{i % 977} " for i in range(30_000))


@pytest.fixture()
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and columns whose names operators use inside."""
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *(T.StructField(c, T.StringType()) for c in ("id", "key", "kind", "score", "sig", "comp", "items", "label", "ids")),
        T.StructField("h", T.DateType())])
    texts = [(0, "One plain line of text that is long enough to matter here."), (1, None), (2, ""), (3, "   \n\t\n "),
             (4, LONG), (5, "x" * 70_000), (6, "Repeated row, the same in both."), (6, "Repeated row, the same in both."),
             (7, "One plain line of text that is long enough to matter here."), (None, "A row without an id."),
             (8, "日本語のテキスト 🎉 é ñ"), (9, "1234 !!! ---")]
    return spark.createDataFrame(
        [(i, t, "en" if i != 3 else None, "s", len(t or ""), *["x"] * 9, dt.date(2024, 1, 1)) for i, t in texts], schema)


@pytest.fixture()
def no_docs(edge_docs):
    return edge_docs.limit(0)
