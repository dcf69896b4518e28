"""Key/value routing jobs: source, redistribution, checksummed CSV output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinogrid import sinks
from sinogrid.config import KvConfig
from sinogrid.functions.hashing import record_checksum
from sinogrid.operators import routing
from sinogrid.sources import generators

# Redistribution of each job; those in TARGETED give every row a target number.
FORWARD, SHUFFLE, BROADCAST = "join", "shuffle", "broadcast"
REROUTE, INTERLEAVE = "reroute", "reroute-interleave"
JOBS = (FORWARD, SHUFFLE, BROADCAST, REROUTE, INTERLEAVE)
TARGETED = (BROADCAST, REROUTE, INTERLEAVE)


def with_target(df: DataFrame, job: str, targets: int, already: int = 0) -> DataFrame:
    if job == BROADCAST:
        return routing.broadcast_to_all(df, targets)
    if job == REROUTE:
        return routing.with_shift_zero(df, targets)
    if job == INTERLEAVE:
        return routing.with_interleave(df, targets, already=already)
    raise ValueError(f"job {job} has no target numbers")


def route(df: DataFrame, job: str, targets: int, splits: int = 1, already: int = 0) -> DataFrame:
    """Rows placed as the job asks; one exchange, whatever the job."""
    if job == FORWARD:
        return routing.forward(df, targets)
    if job == SHUFFLE:
        return routing.shuffle(df, targets)
    return routing.place(with_target(df, job, targets, already), targets, splits=splits)


def target_summary(routed: DataFrame) -> DataFrame:
    """Records, values and checksums per target.

    The checksum depends on the key alone, so keys are counted first and each
    is hashed once per target.
    """
    return _summed(_counted(routed, "sink_id", "key"))


def broadcast_summary(df: DataFrame, targets: int) -> DataFrame:
    """`target_summary` of a broadcast: every target gets the same records.

    Keys are counted and hashed before their copies go out, so that no task
    holds a key once per target.
    """
    return _summed(routing.broadcast_to_all(_counted(df, "key"), targets))


def _counted(df: DataFrame, *group: str) -> DataFrame:
    per_key = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.sum("val").alias("v"))
    return per_key.withColumn("c", record_checksum(F.col("key")))


def _summed(per_key: DataFrame) -> DataFrame:
    # XOR of n equal values: the value when n is odd, else 0
    odd = F.when(F.col("n") % 2 == 1, F.col("c")).otherwise(F.lit(0))
    return per_key.groupBy("sink_id").agg(
        F.sum("n").alias("records"), F.count(F.lit(1)).alias("keys"),
        F.sum("v").alias("total"), F.bit_xor(odd).alias("checksum"))


def run_batch(spark: SparkSession, job: str, cfg: KvConfig, path: str, splits: int = 1) -> None:
    """Generate `maxRecords` records, route them and write the CSV files."""
    routed = route(generators.kv_batch(spark, cfg), job, cfg.sinkParallelism, splits)
    sinks.write_kv_csv(routed, path)
