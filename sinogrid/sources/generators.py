"""Bounded and rate-limited record generators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinogrid.config import KvConfig, TomoConfig
from sinogrid.functions.hashing import with_murmur_u32

# Fixed value: number of different values a record may carry.
VALUE_RANGE = 10


def with_kv(df: DataFrame, cfg: KvConfig, seq: str = "seq") -> DataFrame:
    """Key and value of each sequence number, spread by a hash of it.

    The same sequence number gives the same record on every run, so a retried
    task emits what the lost one did.
    """
    df = df.withColumn("_s", F.col(seq) * 2 + F.lit(cfg.seed))
    df = with_murmur_u32(df, "_s", "_h")
    df = df.withColumn("key", F.concat(F.lit("key"), F.pmod("_h", F.lit(cfg.num_keys)).cast("string")))
    df = with_murmur_u32(df.withColumn("_s", F.col("_s") + 1), "_s", "_h")
    df = df.withColumn("val", F.pmod("_h", F.lit(VALUE_RANGE)).cast("int"))
    return df.drop("_s", "_h")


def kv_batch(spark: SparkSession, cfg: KvConfig) -> DataFrame:
    if cfg.maxRecords >= 2**62:
        raise ValueError("a batch needs maxRecords")
    rows = spark.range(cfg.maxRecords).select(F.col("id").alias("seq"))
    return with_kv(rows, cfg)


def kv_stream(spark: SparkSession, cfg: KvConfig) -> DataFrame:
    rate = (spark.readStream.format("rate")
            .option("rowsPerSecond", cfg.rows_per_second)
            .option("numPartitions", cfg.sourceParallelism).load())
    rows = rate.select(F.col("value").alias("seq"), F.col("timestamp").alias("ts"))
    return with_kv(rows.where(F.col("seq") < cfg.maxRecords), cfg)


# -- ticks ------------------------------------------------------------------

def tick_columns(seq: DataFrame, projections: int) -> DataFrame:
    """Iteration and kind of each data tick."""
    iteration = F.floor((F.col("seq") - 1) / F.lit(projections)).cast("int")
    return seq.select(F.col("seq").cast("bigint"), iteration.alias("iter"),
                      F.lit("DATA").alias("kind"))


def tick_sequence(spark: SparkSession, total: int) -> DataFrame:
    return spark.range(1, total + 1).select(F.col("id").alias("seq"))


def ticks(spark: SparkSession, cfg: TomoConfig) -> DataFrame:
    return tick_columns(tick_sequence(spark, cfg.total_ticks), cfg.num_sinogram_projections)


def tick_stream(spark: SparkSession, cfg: TomoConfig) -> DataFrame:
    rate = spark.readStream.format("rate").option("rowsPerSecond", cfg.rows_per_second).load()
    seq = rate.where(F.col("value") < cfg.total_ticks).select((F.col("value") + 1).alias("seq"))
    return tick_columns(seq, cfg.num_sinogram_projections)


def control_tick(spark: SparkSession, kind: str, seq: int, iteration: int) -> DataFrame:
    return spark.range(1).select(F.lit(seq).cast("bigint").alias("seq"),
                                 F.lit(iteration).cast("int").alias("iter"),
                                 F.lit(kind).alias("kind"))


def with_control_ticks(spark: SparkSession, data: DataFrame, total: int, iterations: int) -> DataFrame:
    """WARMUP before and FIN after the data ticks."""
    first = control_tick(spark, "WARMUP", 0, 0)
    last = control_tick(spark, "FIN", total + 1, iterations)
    return first.unionByName(data).unionByName(last)
