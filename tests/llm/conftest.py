import pytest

#: Nulls, empties, repeated rows, ties, a long text, and columns whose names clash with results.
LONG = " ".join(f"word{i % 977} item{i % 31}" for i in range(30_000))
ROWS = [
    (1, None), (2, ""), (3, "one two three four five six seven"), (4, "one two three four five six seven"), (4, "one two three four five six seven"),
    (5, "short"), (6, "  \n "), (7, LONG), (8, LONG + " tail"), (None, "no id here at all in this row"), (9, "é" * 50), (10, "short"),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ROWS, "doc_id long, text string")
    extra = {c: F.lit("x") for c in ("lang", "source", "kept", "keep_id", "shard", "score", "id", "hash", "length", "piece", "class_id", "bands")}
    return docs.withColumns(extra).withColumn("n_chars", F.lit(0).cast("long"))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
