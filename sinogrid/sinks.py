"""Batch sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinogrid.functions.hashing import record_checksum

KV_SCHEMA = "key STRING, val INT, checksum BIGINT"


def kv_lines(df: DataFrame) -> DataFrame:
    """The written columns: key, value and checksum of the key."""
    return df.select("key", "val", record_checksum(F.col("key")).alias("checksum"))


def write_kv_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    kv_lines(df).write.mode(mode).csv(path)


def read_kv_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(KV_SCHEMA).csv(path)


def write_iterations(df: DataFrame, path: str) -> None:
    """One folder per iteration, rows in order inside it; a rerun replaces its iterations.

    Rows are ranged over (iteration, row_id), so an iteration with many rows is
    written by several tasks, each with its own run of rows.
    """
    (df.repartitionByRange("iteration", "row_id").sortWithinPartitions("iteration", "row_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("iteration").parquet(path))


def read_iterations(spark: SparkSession, path: str, schema) -> DataFrame:
    # given as text: a label such as 000012 would be inferred as a number
    return spark.read.schema(schema).parquet(path)


def write_frames(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Keep a typed frame table beside its source for later scans."""
    df.write.mode(mode).parquet(path)
