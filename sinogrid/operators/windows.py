"""Count-based windows, emission gates and order-based filters.

With rn the 1-based arrival number in its key, window length W and step S, pass
k (1, 2, ...) fires at arrival k*S. It covers the last n_k messages:
k*S while (k-1)*S < W, else max(W, S). During ramp-up a window may therefore be
longer than W. Messages after the last full step never fire.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinogrid.operators.blocked import Running, keyed_rank, running


def window_size(k: Column, length: int, step: int) -> Column:
    ramp = (k - 1) * step < length
    return F.when(ramp, k * step).otherwise(F.lit(max(length, step)))


def in_window(rn: Column, k: Column, length: int, step: int) -> Column:
    return (rn <= k * step) & (rn > k * step - window_size(k, length, step))


def first_pass(rn: Column, step: int) -> Column:
    return F.ceil(rn / F.lit(step))


def last_pass(rn: Column, length: int, step: int) -> Column:
    """Last pass that covers arrival rn when enough messages follow."""
    steady = F.ceil((rn + max(length, step)) / F.lit(step)) - 1
    ramp_end = -(-length // step)
    return F.when(first_pass(rn, step) <= ramp_end,
                  F.greatest(steady, F.lit(ramp_end))).otherwise(steady)


def count_windows(rows: DataFrame, length: int, step: int, keys: list[str],
                  order: list[str], block: Column | None = None) -> DataFrame:
    """One row per (message, window it belongs to); `pass` counts from 1.

    A message joins at most ceil(max(W, S)/S) windows beyond the ramp-up.
    """
    ranked = keyed_rank(rows, keys, order, block, out="rn", total="_n")
    fired = F.floor(F.col("_n") / F.lit(step))
    last = F.least(last_pass(F.col("rn"), length, step), fired)
    first = first_pass(F.col("rn"), step)
    member = ranked.where(first <= last).withColumn("pass", F.explode(F.sequence(first, last)))
    return member.drop("_n")


def window_view(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Per window: size, range of arrivals and the centre of its last message."""
    return windows.groupBy(*keys, "pass").agg(
        F.count(F.lit(1)).alias("messages"),
        F.min("rn").alias("first_rn"), F.max("rn").alias("last_rn"),
        F.max_by("center", "rn").cast("bigint").alias("center"),
        F.min("theta").alias("min_theta"), F.max("theta").alias("max_theta"))


def emit_gate(pass0: Column, write_freq: int) -> Column:
    """True for the passes (counted from 0) whose image is emitted."""
    return F.pmod(pass0, F.lit(write_freq)) == 0


def pass_label(pass0: Column) -> Column:
    return F.format_string("%06d", pass0.cast("bigint"))


def snapshot_points(rows: DataFrame, freq: int, keys: list[str], order: list[str],
                    block: Column | None = None) -> DataFrame:
    """Messages after which the state of their key is saved."""
    ranked = keyed_rank(rows, keys, order, block, out="processed")
    return ranked.where(F.pmod(F.col("processed"), F.lit(freq)) == 0)


def monotone_dedup(rows: DataFrame, keys: list[str], order: list[str],
                   block: Column | None = None, seq: str = "seq") -> DataFrame:
    """Keep messages whose `seq` is above every earlier one of their key."""
    top = {"_top": Running(F.col(seq), "max", own_row=False)}
    out = running(rows, keys, order, block, top)
    return out.where(F.col("_top").isNull() | (F.col(seq) > F.col("_top"))).drop("_top")


def after_fin_filter(rows: DataFrame, keys: list[str], order: list[str],
                     block: Column | None = None) -> DataFrame:
    """Drop what follows the FIN message of its key."""
    fin = F.when(F.col("kind") == "FIN", 1).otherwise(0)
    out = running(rows, keys, order, block, {"_ended": Running(fin, "max", own_row=False)})
    return out.where(F.coalesce(F.col("_ended"), F.lit(0)) == 0).drop("_ended")
