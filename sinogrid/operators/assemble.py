"""Gathering of complete iterations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_rows(messages: DataFrame, num_sinograms: int) -> DataFrame:
    """(iteration, row_id, arrival) of the messages that make up complete iterations.

    An iteration is complete at the arrival that brings its last missing row.
    Until then a later message of a row replaces the earlier one; afterwards the
    iteration has been emitted. `messages` needs iteration, row_id and arrival,
    unique and rising per iteration. No list is built, so an iteration may have
    any number of rows.
    """
    first = messages.groupBy("iteration", "row_id").agg(F.min("arrival").alias("_first"))
    done = (first.groupBy("iteration")
            .agg(F.count(F.lit(1)).alias("_rows"), F.max("_first").alias("_done"))
            .where(F.col("_rows") == num_sinograms).select("iteration", "_done"))
    kept = messages.select("iteration", "row_id", "arrival").join(done, "iteration")
    return (kept.where(F.col("arrival") <= F.col("_done"))
            .groupBy("iteration", "row_id").agg(F.max("arrival").alias("arrival")))


def assemble_iterations(messages: DataFrame, num_sinograms: int) -> DataFrame:
    """Payload rows of complete iterations, one message per row id."""
    winners = complete_rows(messages, num_sinograms)
    return messages.join(winners, ["iteration", "row_id", "arrival"], "left_semi")


def iteration_notices(messages: DataFrame, num_sinograms: int) -> DataFrame:
    """One notice per complete iteration, from the row that completed it."""
    first = messages.groupBy("iteration", "row_id").agg(F.min("arrival").alias("_first"))
    done = (first.groupBy("iteration")
            .agg(F.count(F.lit(1)).alias("_rows"), F.max_by("row_id", "_first").alias("row_id"))
            .where(F.col("_rows") == num_sinograms))
    return done.select("row_id", F.lit("DENOISED").alias("status"), "iteration")
