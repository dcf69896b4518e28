"""Redistribution of records over a number of targets.

`with_*` functions add the target number `sink_id`; `place` then moves each row
to exactly that partition with one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinogrid.functions.hashing import PARTITION_SEED, java_hash, with_murmur_inv_u32, with_murmur_u32
from sinogrid.operators.blocked import block_of, keyed_rank

# Fixed value: records sent to one target before the next one is used.
INTERLEAVE_GROUP = 1000

SINK = "sink_id"


def place(df: DataFrame, targets: int, sink: str = SINK, splits: int = 1) -> DataFrame:
    """Move each row to the partition of its target.

    With `splits` > 1 a target owns that many partitions, numbered
    target*splits onwards, so a target that draws a large part of the data is
    written by several tasks.
    """
    target = F.col(sink).cast("int")
    if splits > 1:
        rest = [F.col(c) for c in df.columns]
        target = target * splits + F.pmod(F.xxhash64(*rest), F.lit(splits)).cast("int")
    return df.repartitionById(targets * splits, target)


def forward(df: DataFrame, targets: int | None = None) -> DataFrame:
    """Records stay where they are; another number of targets rebalances them."""
    return df if targets is None else df.repartition(targets)


def shuffle(df: DataFrame, targets: int) -> DataFrame:
    return df.repartition(targets)


def broadcast_to_all(df: DataFrame, targets: int) -> DataFrame:
    """One copy of every record per target."""
    return df.withColumn(SINK, F.explode(F.sequence(F.lit(0), F.lit(targets - 1))))


def hash_target(key: Column, targets: int) -> Column:
    # abs() of the smallest int has no positive value; BIGINT avoids that case.
    return (F.abs(java_hash(key).cast("bigint")) % targets).cast("int")


def with_shift_zero(df: DataFrame, targets: int, key: str = "key") -> DataFrame:
    """Hash target, target 0 rerouted to 1."""
    df = df.withColumn(SINK, hash_target(F.col(key), targets))
    if targets < 2:
        return df
    return df.withColumn(SINK, F.when(F.col(SINK) == 0, 1).otherwise(F.col(SINK)))


def interleave_target(count: Column, targets: int) -> Column:
    """Target of the count-th (from 0) record that hashed to target 0."""
    group = F.floor(count / F.lit(INTERLEAVE_GROUP))
    return (group % (targets - 1) + 1).cast("int")


def with_interleave(df: DataFrame, targets: int, key: str = "key", order: str = "seq",
                    block_width: int = 1 << 18, already: int = 0) -> DataFrame:
    """Hash target; records of target 0 go in groups of 1000 to the others in turn.

    Their number is taken in the order of `order`, after `already` earlier ones.
    """
    df = df.withColumn(SINK, hash_target(F.col(key), targets))
    if targets < 2:
        return df
    zero = keyed_rank(df.where(F.col(SINK) == 0), [], [order],
                      block_of(F.col(order), block_width), out="_nth")
    count = F.col("_nth") - 1 + F.lit(already)
    zero = zero.withColumn(SINK, interleave_target(count, targets)).drop("_nth")
    return df.where(F.col(SINK) != 0).unionByName(zero)


def modulo_target(key: Column, targets: int) -> Column:
    return F.pmod(key, F.lit(targets)).cast("int")


def with_modulo(df: DataFrame, targets: int, key: str = "row_id") -> DataFrame:
    return df.withColumn(SINK, modulo_target(F.col(key), targets))


def with_balanced_key(df: DataFrame, source: str = "row_id", out: str = "place_key") -> DataFrame:
    """Add the INT key whose hash, as Spark partitions by it, is `source`.

    Then `repartition(n, out)` alone puts a row into partition `source` modulo
    n, for every n: consecutive ids are dealt out evenly, and whatever keeps
    that partitioning (a join or aggregate on `out`) needs no further exchange.
    `source` has to fit into 32 bits with sign; a null, and what does not fit,
    gets a null key.
    """
    value = F.col(source).cast("bigint")
    df = with_murmur_inv_u32(df, source, out, PARTITION_SEED)
    signed = F.when(F.col(out) >= 2**31, F.col(out) - F.lit(2**32)).otherwise(F.col(out)).cast("int")
    return df.withColumn(out, F.when(value.between(-2**31, 2**31 - 1), signed))


def partition_load(df: DataFrame, *extra: str) -> DataFrame:
    """Rows in each partition of `df` as it lies (per value of `extra`)."""
    return (df.select(*extra, F.spark_partition_id().alias("part")).groupBy(*extra, "part")
            .agg(F.count(F.lit(1)).alias("records")))


def key_or_random(df: DataFrame, num_keys: int, key: str = "row_id", seed: str = "seq") -> DataFrame:
    """Fill a missing key with a spread, but repeatable, value in [0, num_keys)."""
    df = with_murmur_u32(df, seed, "_spread")
    filled = F.coalesce(F.col(key).cast("bigint"), F.pmod(F.col("_spread"), F.lit(num_keys)))
    return df.withColumn(key, filled).drop("_spread")


def target_load(df: DataFrame, sink: str = SINK) -> DataFrame:
    """Records per target with their share of the whole."""
    per_target = df.groupBy(sink).agg(F.count(F.lit(1)).alias("records"))
    # a window over as many rows as there are targets
    return per_target.withColumn("share", F.col("records") / F.sum("records").over(Window.partitionBy(F.lit(0))))
