"""Shared-folder tables, size-checked joins and exact distributed ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.sources.scratch import materialise, shared_dir, shared_path

__all__ = ["lookup_join", "materialise", "ranked", "small_batches", "without_ids", "shared_dir", "shared_path", "text_or_empty"]

#: A table with at most this many (narrow) rows may be broadcast.
BROADCAST_ROWS = 200_000
#: Rows of texts that go to Python at a time.
BATCH_ROWS = 1000


def lookup_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Join a large table with a keyed, already materialised one.

    ``right`` is broadcast only after its rows were counted and found to be at
    most ``limit``; beyond that both sides are shuffled, and AQE splits hot keys
    of the left side because the right one comes straight from storage.
    """
    small = right.limit(limit + 1).count() <= limit
    return left.join(F.broadcast(right) if small else right, list(on), how)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def small_batches(spark: SparkSession) -> None:
    """Have the session send Python at most ``BATCH_ROWS`` rows at a time.

    Both sides hold a batch whole, and rows here are texts; the default of ten
    thousand rows is tens of megabytes of ordinary texts for every task.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def without_ids(docs: DataFrame, id_col: str, dropped: DataFrame) -> DataFrame:
    """``docs`` without the rows whose id is in the stored one-column table ``dropped``; null ids stay, and all columns, whatever their names."""
    rows = docs.select(F.col(id_col).alias("__wm_id"), F.struct(*[F.col(c) for c in docs.columns]).alias("__wm_row"))
    return lookup_join(rows, dropped.toDF("__wm_id"), ["__wm_id"], "left_anti").select("__wm_row.*")


def ranked(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str, buckets: int | Column = 2048
) -> DataFrame:
    """Exact rank from 0 within each value of ``keys``, without a task per key.

    Rows of a key are dealt to ``buckets`` by the hash of ``order``; the buckets'
    counts become offsets, and only rows of one bucket are sorted together.
    ``buckets`` times the number of keys bounds the table that is broadcast, so
    the keys must come from a small fixed domain (shards, piece lengths).
    """
    count = F.lit(buckets) if isinstance(buckets, int) else buckets
    dealt = df.withColumn("__wm_b", F.pmod(F.xxhash64(*order), count.cast("long")))
    key = [*keys, "__wm_b"]
    before = Window.partitionBy(*keys).orderBy("__wm_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*key)
        .agg(F.count(F.lit(1)).alias("__wm_n"))
        .select(*key, F.coalesce(F.sum("__wm_n").over(before), F.lit(0)).alias("__wm_o"))
    )
    within = Window.partitionBy(*key).orderBy(*order)
    return (
        dealt.withColumn("__wm_r", F.row_number().over(within) - 1)
        .join(F.broadcast(offsets), key)
        .withColumn(out, F.col("__wm_r") + F.col("__wm_o"))
        .drop("__wm_b", "__wm_r", "__wm_o")
    )
