"""Count windows over a stream.

`start_count_windows` numbers each micro-batch with the batch operators and
keeps counts and recent messages in tables, so a key may hold any share of a
batch. `stateful_count_windows` keeps them in the state store: lower latency, and
in memory the sequence numbers of one key in a micro-batch and the reach of a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sinogrid import scratch
from sinogrid.operators import windows
from sinogrid.operators.blocked import block_of, keyed_rank

OUTPUT = "row_id BIGINT, pass BIGINT, rn BIGINT, seq BIGINT"
STATE = "count BIGINT, recent ARRAY<BIGINT>"
RECENT = "row_id BIGINT, seq BIGINT, rn BIGINT"
COUNTS = "row_id BIGINT, n BIGINT"
OUT_ROWS = 10_000  # rows of fired windows that go out together


def start_count_windows(rows: DataFrame, length: int, step: int, root: str, checkpoint: str,
                        block_width: int = 65536, available_now: bool = False) -> StreamingQuery:
    """Write (row_id, pass, rn, seq) of fired windows below `root`.

    Messages of a batch are taken in the order of `seq`. The tables of a batch
    carry its number and `counts` is written last, so a repeated batch replaces
    its own output and a committed one does nothing.
    """
    reach = max(length, step)

    def read(spark: SparkSession, name: str, batch: int, schema: str) -> DataFrame:
        path = f"{root}/{name}/batch={batch}"
        if batch >= 0 and scratch.committed(spark, path):
            return spark.read.schema(schema).parquet(path)
        return spark.createDataFrame([], schema)

    def write(df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch}")

    def process(df: DataFrame, batch: int) -> None:
        spark = df.sparkSession
        if scratch.committed(spark, f"{root}/counts/batch={batch}"):
            return
        before = read(spark, "counts", batch - 1, COUNTS)
        ranked = keyed_rank(df.select("row_id", "seq"), ["row_id"], ["seq"],
                            block_of(F.col("seq"), block_width), out="_rn")
        ranked = ranked.join(before, "row_id", "left").select(
            "row_id", "seq", (F.coalesce("n", F.lit(0)) + F.col("_rn")).alias("rn"))
        write(ranked, "new", batch)
        new = read(spark, "new", batch, RECENT)
        counts = before.select("row_id", F.col("n").alias("old"), F.col("n").alias("now")).unionByName(
            new.groupBy("row_id").agg(F.lit(0).cast("bigint").alias("old"), F.max("rn").alias("now")))
        counts = counts.groupBy("row_id").agg(F.max("old").alias("old"), F.max("now").alias("now"))
        known = read(spark, "recent", batch - 1, RECENT).unionByName(new).join(counts, "row_id")
        done, due = (F.floor(F.col(c) / F.lit(step)) for c in ("old", "now"))
        first = F.greatest(windows.first_pass(F.col("rn"), step), done + 1)
        last = F.least(windows.last_pass(F.col("rn"), length, step), due)
        passes = F.when(first <= last, F.sequence(first, last))
        write(known.withColumn("pass", F.explode(passes)).select("row_id", "pass", "rn", "seq"), "fired", batch)
        write(known.where(F.col("rn") > due * step - reach).select("row_id", "seq", "rn"), "recent", batch)
        write(counts.select("row_id", F.col("now").alias("n")), "counts", batch)
        scratch.discard(spark, f"{root}/new/batch={batch}")
        for name in ("recent", "counts"):
            scratch.discard(spark, f"{root}/{name}/batch={batch - 1}")

    writer = rows.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def fired_windows(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(OUTPUT).parquet(f"{root}/fired/batch=*")


def stateful_count_windows(rows: DataFrame, length: int, step: int) -> DataFrame:
    """Windows as they fire, one row per (message, pass), from keyed state.

    The state of a key is its message count and the sequence numbers that later
    windows can still cover. Messages of a micro-batch are taken in the order of
    `seq`.
    """
    keep = length + step

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, recent = state.get if state.exists else (0, [])
        # Spark cuts the messages of a key into Arrow batches anywhere and in no order.
        new = np.sort(np.concatenate([batch["seq"].to_numpy() for batch in batches]))
        known, first = np.concatenate([np.array(recent, dtype=new.dtype), new]), count - len(recent)
        held, rows = [], 0
        last = (count + len(new)) // step
        for k in range(count // step + 1, last + 1):
            size = k * step if (k - 1) * step < length else max(length, step)
            held.append((k, np.arange(k * step - size + 1, k * step + 1)))
            rows += size
            if rows >= OUT_ROWS or k == last:
                rn = np.concatenate([numbers for _, numbers in held])
                passes = np.repeat([k for k, _ in held], [len(numbers) for _, numbers in held])
                yield pd.DataFrame({"row_id": key[0], "pass": passes, "rn": rn, "seq": known[rn - 1 - first]})
                held, rows = [], 0
        state.update((count + len(new), known[-keep:].tolist()))

    return rows.select("row_id", "seq").groupBy("row_id").applyInPandasWithState(
        advance, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
