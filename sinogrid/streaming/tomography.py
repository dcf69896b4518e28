"""Streaming reconstruction.

Each micro-batch is taken through cleaning, numbering, the passes that became
due, and the gathering of complete iterations. What the next batch needs is
written under the number of this one:

    progress  row_id, n, last_seq, fin_seq      written last: it commits the batch
    tail      messages that later windows can still cover
    calib     calibration frames since the last reset of their set
    image     the current image of every row id: a batch writes those it changed
    open      emitted images of iterations that still lack rows, likewise

A batch that is repeated after a failure finds either its commit, and does
nothing, or the tables of the batch before, and replaces its own. Nothing is
held in memory between batches, so a restart at any point gives the result of
an uninterrupted run.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sinogrid import scratch, sinks
from sinogrid.config import TomoConfig
from sinogrid.operators import calibrate, records, sirt
from sinogrid.operators.blocked import block_of, keyed_rank
from sinogrid.plans import reconstruct
from sinogrid.sources.frames import ITYPES
from sinogrid.streaming.store import DeltaTable

MESSAGE = "row_id BIGINT, seq BIGINT, theta DOUBLE, center DOUBLE, ray ARRAY<DOUBLE>, rn BIGINT"
PROGRESS = "row_id BIGINT, n BIGINT, last_seq BIGINT, fin_seq BIGINT"
IMAGE = "row_id BIGINT, tile INT, vals ARRAY<DOUBLE>"
OPEN = "row_id BIGINT, tile INT, vals ARRAY<DOUBLE>, iteration STRING"
NEVER = 2**63 - 1
# number under which a run keeps the state that it was begun with
BEGUN = -1


class Reconstruction:
    """The tables of one streaming reconstruction below `root`."""

    def __init__(self, spark: SparkSession, root: str, cfg: TomoConfig, spread: Callable[[DataFrame], DataFrame] | None = None):
        """`spread` is applied to the cleaned rows of a batch, for example to repeat them."""
        if cfg.num_sinograms < 1:
            raise ValueError("num_sinograms is needed: an iteration is complete when that many row ids are there")
        self.spark, self.root, self.cfg, self.spread = spark, root.rstrip("/"), cfg, spread or (lambda rows: rows)

    # -- tables -------------------------------------------------------------

    def _path(self, name: str, batch: int) -> str:
        return f"{self.root}/{name}/batch={batch}"

    def _read(self, name: str, batch: int, schema) -> DataFrame:
        path = self._path(name, batch)
        if batch >= BEGUN and scratch.committed(self.spark, path):
            return self.spark.read.schema(schema).parquet(path)
        return self.spark.createDataFrame([], schema)

    def _write(self, df: DataFrame, name: str, batch: int) -> DataFrame:
        path = self._path(name, batch)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def images(self) -> DeltaTable:
        return DeltaTable(self.spark, self.root, "image", IMAGE, ["row_id"])

    def waiting(self) -> DeltaTable:
        return DeltaTable(self.spark, self.root, "open", OPEN, ["iteration", "row_id"])

    @property
    def output(self) -> str:
        return f"{self.root}/recon"

    def iterations(self) -> DataFrame:
        """Complete iterations written so far, in tiles."""
        return sinks.read_iterations(self.spark, self.output, OPEN)

    def progress(self, batch: int) -> DataFrame:
        return self._read("progress", batch, PROGRESS)

    def rejected(self) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.root}/rejected").parquet(f"{self.root}/rejected/batch=*")

    # -- restore ------------------------------------------------------------

    def last_batch(self) -> int | None:
        """The newest committed batch."""
        return max(scratch.numbers(self.spark, f"{self.root}/progress", "batch"), default=None)

    def restore(self, earlier: Reconstruction, only: DataFrame | None = None) -> None:
        """Begin this run, which has no batch yet, with what `earlier` had after its last batch.

        `only` (a column row_id) names the row ids to take; without it all are
        taken. Their messages, counts, calibration frames, images and emitted
        images that wait for other row ids are copied, so the run goes on as if
        it had not been interrupted. Iterations that `earlier` has written stay
        with it. Progress is written last: a restore that failed can be repeated.
        """
        batch = earlier.last_batch()
        if batch is None:
            raise ValueError("nothing to restore: the earlier run has no committed batch")
        if self.last_batch() not in (None, BEGUN):
            raise ValueError("a run can only be restored before its first batch")

        def chosen(df: DataFrame) -> DataFrame:
            return df if only is None else df.join(only.select("row_id").distinct(), "row_id", "left_semi")

        if scratch.committed(self.spark, earlier._path("calib", batch)):
            self._write(chosen(self.spark.read.parquet(earlier._path("calib", batch))), "calib", BEGUN)
        self._write(chosen(earlier._read("tail", batch, MESSAGE)), "tail", BEGUN)
        for ours, theirs in ((self.images(), earlier.images()), (self.waiting(), earlier.waiting())):
            ours.write(chosen(theirs.read(batch)), BEGUN)
        self._write(chosen(earlier.progress(batch)), "progress", BEGUN)

    # -- one micro-batch ----------------------------------------------------

    def process(self, frames: DataFrame, batch: int) -> None:
        self.spark = frames.sparkSession
        if scratch.committed(self.spark, self._path("progress", batch)):
            return
        before = self.progress(batch - 1)
        fins, rows = self._split(frames)
        rows = self.spread(self._clean(self._check(rows, batch), batch))
        new, ends = self._number(rows, fins, before, batch)
        work = self._due(new, before, batch)
        start = self.images().read(batch - 1, work.where("fired > done").select("row_id"))
        fired = reconstruct.fire(work, self._path("run", batch), self.cfg, start)
        self._gather(fired, batch)
        self._keep_images(fired, batch)
        self._commit(new, ends, before, batch)

    def _split(self, frames: DataFrame):
        """(FIN number per row id or None, data rows)."""
        if "kind" not in frames.columns:
            return None, frames
        control, rows = records.split_control(frames)
        fins = control.where(F.col("kind") == "FIN").groupBy("row_id").agg(F.min("seq").alias("fin_seq"))
        return fins, rows.drop("kind")

    def _check(self, rows: DataFrame, batch: int) -> DataFrame:
        usable, rejected = records.checked(rows, self.cfg.num_sinogram_columns, self.cfg.checksum)
        self._write(rejected, "rejected", batch)
        return usable

    def _clean(self, rows: DataFrame, batch: int) -> DataFrame:
        if "itype" not in rows.columns:
            return rows
        if self.cfg.normalize:
            schema = rows.schema
            earlier = self._read("calib", batch - 1, schema)
            own = rows.where(F.col("itype") != ITYPES["Projection"])
            self._write(_since_reset(earlier.unionByName(own)), "calib", batch)
            rows = earlier.unionByName(rows)
        return calibrate.calibrate(rows, self.cfg, self._path("levels", batch))

    def _number(self, rows: DataFrame, fins, before: DataFrame, batch: int):
        """Accepted messages with their arrival number, written out."""
        rows = rows.select(F.col("row_id").cast("bigint"), F.col("seq").cast("bigint"),
                           F.col("theta").cast("double"), F.col("center").cast("double"),
                           F.col("ray").cast("array<double>"))
        ends = before.select("row_id", "fin_seq")
        if fins is not None:
            ends = ends.unionByName(fins).groupBy("row_id").agg(F.min("fin_seq").alias("fin_seq"))
            ends = self._write(ends, "ends", batch)
        # One progress row per row id: a hash join that Catalyst may broadcast by size.
        rows = (rows.dropDuplicates(["row_id", "seq"])
                .join(before.select("row_id", "n", "last_seq"), "row_id", "left")
                .where(F.col("last_seq").isNull() | (F.col("seq") > F.col("last_seq"))))
        rows = rows.join(ends, "row_id", "left").where(
            F.col("fin_seq").isNull() | (F.col("seq") < F.col("fin_seq"))).drop("fin_seq")
        rows = keyed_rank(rows, ["row_id"], ["seq"], block_of(F.col("seq"), self.cfg.rank_block), out="_rn")
        rows = rows.withColumn("rn", F.coalesce("n", F.lit(0)) + F.col("_rn")).drop("n", "last_seq", "_rn")
        return self._write(rows, "new", batch), ends

    def _due(self, new: DataFrame, before: DataFrame, batch: int) -> DataFrame:
        """Write the messages that the passes due now cover; also the next tail."""
        step, reach = self.cfg.window_step, max(self.cfg.window_length, self.cfg.window_step)
        counts = (before.select("row_id", F.col("n").alias("old"), F.col("n").alias("now"))
                  .unionByName(new.groupBy("row_id").agg(F.lit(0).cast("bigint").alias("old"), F.max("rn").alias("now")))
                  .groupBy("row_id").agg(F.max("old").alias("old"), F.max("now").alias("now")))
        counts = counts.select("row_id", F.floor(F.col("old") / F.lit(step)).alias("done"),
                               F.floor(F.col("now") / F.lit(step)).alias("fired"))
        rows = self._read("tail", batch - 1, MESSAGE).unionByName(new).join(counts, "row_id")
        work = reconstruct.write_work(rows, self.cfg, self._path("work", batch))
        self._write(rows.where(F.col("rn") > F.col("fired") * step - reach).drop("done", "fired"), "tail", batch)
        return work

    def _gather(self, fired: reconstruct.Fired, batch: int) -> None:
        """Write the iterations that are complete now; images that wait for others stay where they were written."""
        waiting = self.waiting()
        new = fired.emitted().select("row_id", "tile", "vals", "iteration")
        known = waiting.manifest(batch - 1).select("iteration", "row_id").unionByName(new.select("iteration", "row_id")).distinct()
        done = (known.groupBy("iteration").agg(F.count(F.lit(1)).alias("_rows"))
                .where(F.col("_rows") == self.cfg.num_sinograms).select("iteration"))
        done = self._write(done, "complete", batch)
        gone = known.join(done, "iteration", "left_semi")
        if not done.isEmpty():
            # a row id emits an iteration once, so nothing new replaces what waits
            sinks.write_iterations(waiting.read(batch - 1, gone).unionByName(new).join(done, "iteration", "left_semi"), self.output)
        waiting.write(new.join(done, "iteration", "left_anti"), batch, gone)

    def _keep_images(self, fired: reconstruct.Fired, batch: int) -> None:
        self.images().write(fired.latest().select("row_id", "tile", "vals"), batch)

    def _commit(self, new: DataFrame, ends: DataFrame, before: DataFrame, batch: int) -> None:
        rows = (before.select("row_id", "n", "last_seq")
                .unionByName(new.groupBy("row_id").agg(F.max("rn").alias("n"), F.max("seq").alias("last_seq")))
                .groupBy("row_id").agg(F.max("n").alias("n"), F.max("last_seq").alias("last_seq")))
        self._write(rows.join(ends, "row_id", "full").select(
            "row_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"), "last_seq", "fin_seq"), "progress", batch)
        # Tables of the batch before are read again only by this batch, which is now committed.
        for name in ("new", "work", "run", "levels", "complete", "ends"):
            scratch.discard(self.spark, self._path(name, batch))
        for name in ("tail", "calib", "progress"):
            scratch.discard(self.spark, self._path(name, batch - 1))
        self.images().tidy(batch)
        self.waiting().tidy(batch)


def _since_reset(frames: DataFrame) -> DataFrame:
    """Calibration frames from the last reset of their set onwards."""
    white = F.col("itype").isin(ITYPES["White"], ITYPES["WhiteReset"])
    reset = F.col("itype").isin(ITYPES["WhiteReset"], ITYPES["DarkReset"])
    named = frames.withColumn("_set", F.when(white, "white").otherwise("dark"))
    last = named.groupBy("row_id", "_set").agg(F.max(F.when(reset, F.col("seq"))).alias("_from"))
    kept = named.join(last, ["row_id", "_set"]).where(F.col("_from").isNull() | (F.col("seq") >= F.col("_from")))
    return kept.select(*frames.columns)


def start(frames: DataFrame, cfg: TomoConfig, root: str, checkpoint: str,
          available_now: bool = False) -> StreamingQuery:
    """Reconstruct a stream of frame rows (row_id, seq, theta, center, ray, ...)."""
    job = Reconstruction(frames.sparkSession, root, cfg)
    writer = frames.writeStream.foreachBatch(job.process).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
