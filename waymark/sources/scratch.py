"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder on a local master, and an error on a cluster."""
    configured = spark.conf.get("spark.checkpoint.dir", "")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _fallback:
        _fallback.append("file://" + tempfile.mkdtemp(prefix="waymark-"))
    return _fallback[0]


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/waymark-{uuid.uuid4().hex}/{tag}"


def materialise(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    It cuts the lineage like a checkpoint, but the copy is compressed, can be
    column-pruned, and survives the loss of any executor. ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
