import pytest
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

#: More columns than the operators need, with names that they use themselves.
DOCS = StructType(
    [
        StructField("doc_id", LongType()),
        StructField("text", StringType()),
        StructField("lang", StringType()),
        StructField("source", StringType()),
        StructField("n_chars", LongType()),
        StructField("h", LongType()),
        StructField("fp", StringType()),
        StructField("chunk", StringType()),
        StructField("score", StringType()),
        StructField("size", StringType()),
    ]
)
VECTORS = StructType(
    [
        StructField("vec_id", LongType()),
        StructField("embedding", ArrayType(DoubleType())),
        StructField("label", IntegerType()),
        StructField("id", StringType()),
        StructField("v", StringType()),
        StructField("pos", StringType()),
    ]
)


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, source) tuples, in several partitions."""

    def make(rows, parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 1, "f", "c", "x", "z") for r in rows]
        return spark.createDataFrame(full, DOCS).repartition(parts)

    return make


@pytest.fixture(scope="session")
def vectors_of(spark):
    def make(rows, parts=3):
        full = [(i, None if v is None else [None if x is None else float(x) for x in v], l, "i", "v", "p") for i, v, l in rows]
        return spark.createDataFrame(full, VECTORS).repartition(parts)

    return make
