"""The tomography job: ticks, frames, cleaning, reconstruction, complete iterations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sinogrid import scratch, sinks
from sinogrid.config import TomoConfig
from sinogrid.operators import calibrate, records
from sinogrid.plans.reconstruct import sirt_reconstruct
from sinogrid.sources import frames as fr
from sinogrid.sources import generators as gen
from sinogrid.streaming import tomography as stream


def image_facts(images: DataFrame) -> tuple[int, int]:
    """(number of frames, detector rows per frame)."""
    facts = images.agg(F.count(F.lit(1)).alias("n"), F.max("ny").alias("ny")).first()
    return facts["n"], facts["ny"]


def source_rows(frames: DataFrame, cfg: TomoConfig) -> DataFrame:
    """Detector-row messages of frames that carry their tick number in `seq`, of no more rows than are asked for."""
    rows = records.explode_rows(frames, cfg.checksum)
    return rows.where(F.col("row_id") < cfg.num_sinograms) if cfg.num_sinograms else rows


def repeated_rows(rows: DataFrame, ny: int, cfg: TomoConfig) -> DataFrame:
    """With fewer detector rows than `num_sinograms` the rows are repeated."""
    return fr.tile_rows(rows, cfg.num_sinograms, ny) if cfg.num_sinograms else rows


def complete_images(emitted: DataFrame, num_sinograms: int) -> DataFrame:
    """Emitted images of the iterations for which every row id is there."""
    rows = emitted.groupBy("iteration", "row_id").agg(F.lit(1).alias("one"))
    done = (rows.groupBy("iteration").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") == num_sinograms).select("iteration"))
    return emitted.join(done, "iteration", "left_semi").select("row_id", "tile", "vals", "iteration")


def run_batch(spark: SparkSession, images: DataFrame, cfg: TomoConfig, path: str) -> DataFrame:
    """Run over all ticks, write complete iterations to `path`, return the notices.

    `images` is typed and numbered from 0 in `seq`. Unusable messages go to
    `path`.rejected with the reason. Rows are calibrated before they are repeated.
    """
    n, ny = image_facts(images)
    frames = fr.cycle_frames(images, n, cfg.num_sinogram_projections, cfg.total_ticks)
    usable, rejected = records.checked(source_rows(frames, cfg), cfg.num_sinogram_columns)
    rejected.write.mode("overwrite").parquet(f"{path.rstrip('/')}.rejected")
    fired = sirt_reconstruct(repeated_rows(calibrate.calibrate(usable, cfg), ny, cfg), cfg)
    num = cfg.num_sinograms or ny
    sinks.write_iterations(complete_images(fired.emitted(), num), path)
    return notices(spark, sinks.read_iterations(spark, path, stream.OPEN), cfg, num)


def notices(spark: SparkSession, images: DataFrame, cfg: TomoConfig, num_sinograms: int) -> DataFrame:
    """(row_id, status, iteration): start, finished iterations and end of the job."""
    def control(kind: str, seq: int) -> DataFrame:
        rows = records.per_row_id(gen.control_tick(spark, kind, seq, 0), num_sinograms)
        return rows.selectExpr("cast(row_id AS BIGINT) AS row_id", "kind AS status", "cast(NULL AS STRING) AS iteration")

    done = images.groupBy("iteration").agg(F.max("row_id").alias("row_id")).selectExpr(
        "row_id", "'DENOISED' AS status", "iteration")
    return control("WARMUP", 0).unionByName(done).unionByName(control("FIN", cfg.total_ticks + 1))


def start_stream(spark: SparkSession, images: DataFrame, cfg: TomoConfig, root: str, checkpoint: str | None = None,
                 ticks: DataFrame | None = None, available_now: bool = False) -> StreamingQuery:
    """The job as one streaming query, from ticks to complete iterations.

    `ticks` (seq, iter, kind) is any stream of them; by default they arrive at
    the configured rate. Without `checkpoint` progress is kept in a folder of
    this run only.
    """
    n, ny = image_facts(images)
    ticks = gen.tick_stream(spark, cfg) if ticks is None else ticks
    writer = ticks.writeStream.foreachBatch(tick_batch(live_job(spark, root, cfg, ny), images, n))
    writer = writer.option("checkpointLocation", checkpoint or scratch.new_folder(spark, "tomo-progress"))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live_job(spark: SparkSession, root: str, cfg: TomoConfig, ny: int) -> stream.Reconstruction:
    """Reconstruction of source rows that are repeated after they are calibrated, as in `run_batch`."""
    return stream.Reconstruction(spark, root, replace(cfg, num_sinograms=cfg.num_sinograms or ny), lambda rows: repeated_rows(rows, ny, cfg))


def tick_batch(job: stream.Reconstruction, images: DataFrame, n: int):
    """Batch writer from ticks to reconstruction: the static frames are filtered to the positions in reach of the ticks, then joined."""
    def process(ticks: DataFrame, batch: int) -> None:
        frames = fr.tick_frames(ticks, fr.frames_in_reach(images, ticks, n), n)
        job.process(source_rows(frames, job.cfg), batch)

    return process
