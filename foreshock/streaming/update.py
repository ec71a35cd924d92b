"""Keeping a day-partitioned table current from micro-batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for checkpoints and results.

    Lies under ``spark.checkpoint.dir`` when the cluster names one; only a local
    session without that setting falls back to a temporary folder.  On any other
    master the setting is required: executors would not see the driver's folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if base:
        return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.mkdtemp(prefix="spark-"), name)


def read_days(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def upsert_days(spark: SparkSession, new: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Rewrite the ``dt`` partitions touched by ``new``; a new row replaces the old one of its keys.

    Only touched days are read and written.  The batch may be retried: the same
    input gives the same partitions.
    """
    keyed = new.withColumn("dt", F.to_date("ts"))
    values = [c for c in keyed.columns if c not in (*keys, "dt")]
    current = read_days(spark, path)
    merged = keyed.withColumn("_new", F.lit(1))
    if current is not None:
        # At most one row per day of the batch; prunes the scan of the table.
        days = keyed.select("dt").distinct()
        touched = current.join(F.broadcast(days), "dt", "left_semi").select(*keyed.columns).withColumn("_new", F.lit(0))
        merged = touched.unionByName(merged)
    last = F.max_by(F.struct(*values), F.col("_new")).alias("_v")
    out = merged.groupBy(*keys, "dt").agg(last).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values], "dt")
    (
        # By day and series: a day of all series is never one task.
        out.repartition("dt", keys[0])
        .sortWithinPartitions(*keys)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dt")
        .parquet(path)
    )


def upsert_sink(path: str, keys: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function that upserts into a day-partitioned table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        upsert_days(batch.sparkSession, batch, path, keys)

    return write


def run_available(stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | None = None, path: str | None = None) -> None:
    """Process what is available now into a ``foreachBatch`` sink or a Parquet folder."""
    writer = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if sink is not None:
        query = writer.foreachBatch(sink).start()
    else:
        query = writer.format("parquet").option("path", path).start()
    query.awaitTermination()
