"""Small helpers the operators share: reading tables and writing intermediate ones."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinogrid import scratch

#: stands for a null doc_id where ids are compared: smaller than any other
NO_ID = -(2**63)


#: most bytes of an Arrow batch, as Spark's setting of them
_BATCH, _BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 2**22


def small_batches(spark: SparkSession) -> None:
    """From now on Arrow batches of the session end at 4 MB, unless it has a lower limit.

    By its 10,000 rows alone a batch of texts takes tens of MB, and several
    times that while the JVM builds and a worker reads it.
    """
    number, unit = re.fullmatch(r"(\d+)([kmgtp]?)b?", spark.conf.get(_BATCH).strip().lower()).groups()
    if int(number) * 2 ** (10 * " kmgtp".index(unit or " ")) > _BATCH_BYTES:
        spark.conf.set(_BATCH, str(_BATCH_BYTES))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: no lineage, no loss with an executor."""
    spark = df.sparkSession
    small_batches(spark)
    path = scratch.new_folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of documents; further columns are left out, a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def residue(modulus: int):
    """crc32 of doc_id written as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def unused(df: DataFrame, name: str) -> str:
    """`name`, or a longer one if `df` has such a column."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


#: has Spark remove a query's shuffle files when the query ends
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str) -> DataFrame:
    """As `stored`, for large tables one after the other: the shuffle files of the write go with it."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return stored(df, name)
    finally:
        conf.set(_CLEANUP, before)


def discarded(df: DataFrame) -> None:
    """Remove a stored table that no later step reads."""
    scratch.discard(df.sparkSession, df.stored_at)
