import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture
def docs_of(spark):
    """A documents table from ``(doc_id, text)`` or ``(doc_id, text, source)`` rows, with an
    extra column whose name clashes with names that operators use."""

    def build(rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        for name in ("row", "_row", "k", "shard", "fp", "block"):
            df = df.withColumn(name, df.n_chars)
        return df

    return build
