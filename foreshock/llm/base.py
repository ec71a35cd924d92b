"""Registry of the queries, shared tables and the split of rows for held-out figures."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foreshock.streaming.update import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def reach(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, and give them texts in small batches.

    Shuffle files go when their job is over: every step ends in a written table.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 1000)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([*paths, root])


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` is the same question for another engine."""

    def wrap(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            reach(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = name, fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return wrap


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the cluster's shared folder and read back: later steps restart from it when executors are lost."""
    path = shared_folder(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._stored_in = path
    return table


def stored_by(df: DataFrame, name: str, column: str, values: list[int]) -> dict[int, DataFrame]:
    """``df`` stored as one table for each of the values of ``column``, which the tables do without."""
    path = shared_folder(df.sparkSession, f"llm-{name}")
    df.write.partitionBy(column).parquet(path)
    schema = df.drop(column).schema
    for v in values:  # a value without rows has no folder
        df.sparkSession.createDataFrame([], schema).write.mode("append").parquet(f"{path}/{column}={v}")
    tables = {v: df.sparkSession.read.schema(schema).parquet(f"{path}/{column}={v}") for v in values}
    for v, table in tables.items():
        table._stored_in = f"{path}/{column}={v}"
    return tables


def discard(table: DataFrame) -> None:
    """Delete a table of :func:`stored` or :func:`stored_by` that nothing reads any more, because what was made of it is stored."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._stored_in)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def remainder(doc_id: str, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % m
