"""Counts, progress and transfer statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

# Fixed value: version of the progress record.
PROGRESS_VERSION = 1


def processed_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("processed"))


def progress_snapshot(rows: DataFrame, source: str, keys: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """Last sequence number and message count per row id."""
    out = rows.groupBy(*keys).agg(F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("nmsgs"))
    return out.withColumn("version", F.lit(PROGRESS_VERSION)).withColumn("input", F.lit(source))


def progress_json(progress: DataFrame) -> DataFrame:
    return progress.withColumn("json", F.to_json(F.struct(*progress.columns)))


OBSERVED = "progress"


def observed(rows: DataFrame, payload_bytes: Column) -> DataFrame:
    """The same rows, counted on their way: a running stream reports the figures with each of its batches."""
    return rows.observe(OBSERVED, F.count(F.lit(1)).alias("messages"),
                        F.coalesce(F.sum(payload_bytes.cast("bigint")), F.lit(0)).alias("bytes"), F.max("seq").alias("last_seq"))


def batch_progress(query: StreamingQuery) -> list[dict]:
    """What a stream of `observed` rows has done: one record for each of its latest batches that had rows.

    Read from the query's own reports, whose number
    `spark.sql.streaming.numRecentProgressUpdates` bounds; no row is read again.
    """
    out = []
    for report in query.recentProgress:
        seen = report.observedMetrics.get(OBSERVED)
        if seen is not None and seen["messages"]:
            seconds = report.batchDuration / 1000
            out.append({"batch": report.batchId, **seen.asDict(), "seconds": seconds,
                        "messages_per_s": seen["messages"] / seconds if seconds else None,
                        "mib_per_s": seen["bytes"] / 1048576 / seconds if seconds else None})
    return out


def throughput_stats(rows: DataFrame, payload_bytes: Column, at: Column,
                     keys: tuple[str, ...] = ()) -> DataFrame:
    """Messages, MiB and their rates between the first and last event time."""
    out = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("messages"),
        (F.sum(payload_bytes.cast("bigint")) / F.lit(1048576.0)).alias("mib"),
        (F.max(at) - F.min(at)).cast("interval second").cast("decimal(18,6)").cast("double").alias("seconds"))
    return (out.withColumn("mib_per_s", F.try_divide("mib", "seconds"))
            .withColumn("messages_per_s", F.try_divide("messages", "seconds")))
