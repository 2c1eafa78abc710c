"""Recorded responses as a stream: each batch is analysed; convergence runs over all that has come.

Groups are global, so a batch's classes may change with later arrivals; the stream
therefore appends analysed rows to a table, and ``converge`` is applied to that table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.functions.rules import Rules
from waymark.plans.analyze import analyze


def append_analysed(responses: DataFrame, rules: Rules, table_path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Analyse every micro-batch and append it; a repeated batch replaces its own folder.

    A site may come in several batches: read the table with ``read_analysed``.
    """

    def batch(df: DataFrame, number: int) -> None:
        analyze(df, rules).write.mode("overwrite").parquet(f"{table_path}/batch={number}")

    return responses.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_analysed(spark: SparkSession, table_path: str) -> DataFrame:
    """What ``append_analysed`` has written so far, one row per site: that of the earliest batch."""
    rows = spark.read.parquet(table_path)
    narrow = F.struct(*[F.col(c) for c in rows.columns if c != "batch"])
    return rows.groupBy(F.col("url").alias("__key")).agg(F.min_by(narrow, "batch").alias("r")).select("r.*")
