"""Streaming key/value jobs: rate source, redistribution, checksummed CSV files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sinogrid import scratch, sinks
from sinogrid.config import KvConfig
from sinogrid.operators import routing
from sinogrid.plans import kv_jobs
from sinogrid.sources import generators


def start(spark: SparkSession, job: str, cfg: KvConfig, path: str, checkpoint: str | None = None,
          source: DataFrame | None = None, available_now: bool = False, splits: int = 1) -> StreamingQuery:
    """Start a job writing below `path`.

    Without `checkpoint` progress is kept in a folder of this run only, so a
    new run starts over. `source` replaces the rate generator; it needs the
    columns seq, key, val.
    """
    stream = generators.kv_stream(spark, cfg) if source is None else source
    checkpoint = checkpoint or scratch.new_folder(spark, "kv-progress")
    if job == kv_jobs.INTERLEAVE:
        batch = _interleave_batch(spark, cfg, path, f"{checkpoint}/zero-count", splits)
        writer = stream.select("seq", "key", "val").writeStream.foreachBatch(batch)
    else:
        routed = kv_jobs.route(stream, job, cfg.sinkParallelism, splits)
        writer = sinks.kv_lines(routed).writeStream.format("csv").option("path", path).outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif cfg.ckptDuration > 0:
        writer = writer.trigger(processingTime=f"{cfg.ckptDuration} milliseconds")
    return writer.start()


def _interleave_batch(spark: SparkSession, cfg: KvConfig, path: str, counts: str, splits: int):
    """Batch writer that goes on counting target-0 records where the last batch ended.

    The count after each batch is kept under the batch number, so a repeated
    batch starts from the same count and replaces its own files.
    """
    targets = cfg.sinkParallelism

    def write(df: DataFrame, batch: int) -> None:
        before = f"{counts}/batch={batch - 1}"
        already = 0
        if scratch.committed(spark, before):
            already = spark.read.parquet(before).first()["n"]
        # kept, because a source may not give its rows in the same form twice
        rows = f"{counts}/rows-{batch}"
        df.write.mode("overwrite").parquet(rows)
        kept = spark.read.schema(df.schema).parquet(rows)
        routed = kv_jobs.route(kept, kv_jobs.INTERLEAVE, targets, splits, already)
        sinks.write_kv_csv(routed, f"{path}/batch={batch}", mode="overwrite")
        zero = kept.where(routing.hash_target(F.col("key"), targets) == 0)
        (zero.agg((F.count(F.lit(1)) + already).alias("n"))
         .write.mode("overwrite").parquet(f"{counts}/batch={batch}"))
        scratch.discard(spark, rows)

    return write


def read_output(spark: SparkSession, job: str, path: str) -> DataFrame:
    if job == kv_jobs.INTERLEAVE:
        return spark.read.schema(sinks.KV_SCHEMA).option("basePath", path).csv(f"{path}/batch=*")
    return sinks.read_kv_csv(spark, path)
