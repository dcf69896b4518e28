"""Windowed reconstruction: passes in order, all row ids of a pass at once.

The image of pass k is the start of pass k + 1, so passes are a sequence of
Spark jobs. Within one, every row id, tile and ray is parallel. Messages are
ranked and written once; each pass reads only the part of that table its window
can reach. Each pass writes its images to the shared folder, which cuts the
lineage and survives lost executors. An image that is neither emitted nor the
last of its row id is removed once the next pass is written.

Passes over small images (one tile) run in one job for all passes instead, each
row id in a task of its own: see `operators/fold`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinogrid import scratch
from sinogrid.config import TomoConfig
from sinogrid.operators import fold, routing, sirt, windows
from sinogrid.operators.blocked import block_of, keyed_rank

# Steps whose messages share a folder of the work table.
CHUNK = 32
# Folders that the images of one job over all passes are written to.
MOST_FOLDERS = 64

IMAGE_SCHEMA = T.StructType([
    T.StructField("row_id", T.LongType()), T.StructField("tile", T.IntegerType()),
    T.StructField("vals", T.ArrayType(T.DoubleType())), T.StructField("pass0", T.LongType()),
    T.StructField("last", T.BooleanType())])


@dataclass(frozen=True)
class Fired:
    """Images written by a run of passes, below `root`."""

    spark: SparkSession
    root: str
    steps: int
    nx: int
    cfg: TomoConfig
    stride: int = 1  # passes whose images share a folder

    def images(self) -> DataFrame:
        """Kept images: row_id, tile, vals, pass0, last."""
        paths = [f"{self.root}/step={j}/keep=1" for j in range(1, self.steps + 1, self.stride)]
        paths = [p for p in paths if scratch.exists(self.spark, p)]
        reader = self.spark.read.schema(IMAGE_SCHEMA)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], IMAGE_SCHEMA)

    def emitted(self) -> DataFrame:
        """Images of the passes that the write frequency lets through, in tiles."""
        out = self.images().where(windows.emit_gate(F.col("pass0"), self.cfg.write_freq))
        return out.withColumn("iteration", windows.pass_label(F.col("pass0"))).drop("last")

    def emitted_pixels(self) -> DataFrame:
        return sirt.image_pixels(self.emitted(), self.nx, self.cfg.tile)

    def latest(self) -> DataFrame:
        """The last image of each row id that fired, in tiles."""
        return self.images().where("last").drop("last")


def message_columns(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("row_id").cast("bigint"), F.col("seq").cast("bigint"),
                       F.col("theta").cast("double"), F.col("center").cast("double"), "ray",
                       *[c for c in ("rn", "done", "fired") if c in rows.columns])


def write_work(rows: DataFrame, cfg: TomoConfig, path: str) -> DataFrame:
    """Ranked messages (rn, done, fired) in folders by the step that first needs them."""
    step = windows.first_pass(F.col("rn"), cfg.window_step) - F.col("done")
    rows = rows.where(F.col("rn") <= F.col("fired") * cfg.window_step).withColumn("step", step)
    rows = rows.withColumn("chunk", F.floor(F.col("step") / F.lit(CHUNK)))
    # the step is part of the key so that a row id with many messages takes several tasks
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if cfg.keying == "modulo":
        placed = routing.place(rows.withColumn("_to", F.pmod(F.col("row_id") + F.col("step"), F.lit(parts))),
                               parts, "_to").drop("_to")
    else:
        placed = rows.repartition(parts, "chunk", "step", "row_id")
    (placed.sortWithinPartitions("chunk", "step")
     .write.mode("overwrite").partitionBy("chunk").parquet(path))
    # the schema is given: a batch without messages leaves no file to infer it from
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def window_rows(work: DataFrame, j: int, cfg: TomoConfig) -> DataFrame:
    """Messages of the window that step `j` of this run fires, per row id."""
    reach = -(-max(cfg.window_length, cfg.window_step) // cfg.window_step)
    k = F.col("done") + j
    rows = work.where(F.col("chunk").between((j - reach) // CHUNK, j // CHUNK)
                      & F.col("step").between(j - reach, j))
    rows = rows.where((F.col("fired") >= k)
                      & windows.in_window(F.col("rn"), k, cfg.window_length, cfg.window_step))
    if int(cfg.center) != 0:
        return rows
    # The last message of the window, the one that fired it, gives the centre.
    newest = work.where((F.col("chunk") == j // CHUNK) & (F.col("step") == j)
                        & (F.col("rn") == k * cfg.window_step))
    newest = newest.select("row_id", F.col("center").alias("_center"))
    return rows.join(newest, "row_id").withColumn("center", F.col("_center")).drop("_center")


def fire(work: DataFrame, root: str, cfg: TomoConfig, start: DataFrame | None = None) -> Fired:
    """Run all passes due in the work table; `start` holds images of earlier runs."""
    spark = work.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = work.agg(F.max(F.col("fired") - F.col("done")).alias("steps"),
                     F.max(F.size("ray")).alias("nx"), F.min(F.size("ray")).alias("least")).first()
    if facts["nx"] != facts["least"]:
        raise ValueError(f"payloads of {facts['least']} to {facts['nx']} samples: all must have one length")
    steps, nx, tile = int(facts["steps"] or 0), int(facts["nx"] or 0), cfg.tile
    if 0 < nx <= min(tile, fold.MOST_COLUMNS):
        return _fire_folded(work, root, cfg, start, steps, nx)
    rows = work.where(F.col("fired") > F.col("done")).groupBy("row_id").agg(
        F.first("done").alias("done"), F.first("fired").alias("fired"))
    if steps:
        rows.write.mode("overwrite").parquet(f"{root}/rows")
        rows = spark.read.parquet(f"{root}/rows")

    for j in range(1, steps + 1):
        active = rows.where(F.col("fired") >= F.col("done") + j)
        window = window_rows(work, j, cfg).select("row_id", "seq", "theta", "center", "ray")
        # Deals the messages out evenly, whatever files they lie in; small beside
        # the expansion that follows. It also keeps the step number out of the
        # stage that expands rays, so its compiled code serves every pass.
        lines = sirt.ray_lines(window.repartition(parts, "row_id", "seq"), cfg.center)
        image, blank = _image_before(spark, root, j, active, start, nx, tile)
        for i in range(cfg.window_iter - 1):
            part = f"{root}/sweep/step={j}/sweep={i}"
            sirt.sweep(lines, image, blank, ["seq"], tile, nx).write.mode("overwrite").parquet(part)
            image = spark.read.parquet(part)
        done = sirt.sweep(lines, image, blank, ["seq"], tile, nx)
        _write_step(done, active, root, j, cfg)
        if j > 1:
            scratch.discard(spark, f"{root}/step={j - 1}/keep=0")
        scratch.discard(spark, f"{root}/sweep/step={j}")
    return Fired(spark, root, steps, nx, cfg)


def _fire_folded(work, root, cfg, start, steps, nx):
    """All passes of each row id in one job."""
    stride = max(1, -(-steps // MOST_FOLDERS))
    if steps:
        begun = work.where((F.col("done") > 0) & (F.col("fired") > F.col("done"))).select("row_id").distinct()
        if start is not None:
            start = start.select("row_id", "vals").join(begun, "row_id", "left_semi")
        at = F.floor((F.col("step") - 1) / F.lit(stride)) * stride + 1
        # a repeated run replaces the folders that it wrote before, and no other
        (fold.folded(work, start, cfg, nx).withColumn("step", at).withColumn("keep", F.lit(1))
         .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("step", "keep").parquet(root))
    return Fired(work.sparkSession, root, steps, nx, cfg, stride)


def _image_before(spark, root, j, active, start, nx, tile):
    """(image, None), or (None, blank) when every row id starts from zero."""
    if j > 1:
        before = spark.read.schema(IMAGE_SCHEMA).parquet(
            *[p for p in (f"{root}/step={j - 1}/keep={n}" for n in (0, 1)) if scratch.exists(spark, p)])
        return before.where(~F.col("last")).drop("pass0", "last"), None
    blank = sirt.blank_image(active.where(F.col("done") == 0), nx, tile)
    if start is None:
        return None, blank
    earlier = start.select("row_id", "tile", "vals").join(active.where(F.col("done") > 0), "row_id", "left_semi")
    return earlier.unionByName(blank), None


def _write_step(image: DataFrame, active: DataFrame, root: str, j: int, cfg: TomoConfig) -> None:
    pass0 = F.col("done") + (j - 1)
    out = image.join(active, "row_id").select(
        F.col("row_id").cast("bigint"), "tile", "vals", pass0.cast("bigint").alias("pass0"),
        (F.col("fired") == F.col("done") + j).alias("last"))
    keep = F.col("last") | windows.emit_gate(F.col("pass0"), cfg.write_freq)
    (out.withColumn("keep", keep.cast("int")).write.mode("overwrite").partitionBy("keep")
     .parquet(f"{root}/step={j}"))


def rank_messages(rows: DataFrame, cfg: TomoConfig, order: list[str] | None = None,
                  block: Column | None = None) -> DataFrame:
    """Arrival number `rn` and number of full steps `fired` per row id."""
    block = block_of(F.col("seq"), cfg.rank_block) if block is None else block
    ranked = keyed_rank(rows, ["row_id"], order or ["seq"], block, out="rn", total="_n")
    ranked = ranked.withColumn("fired", F.floor(F.col("_n") / F.lit(cfg.window_step)))
    return ranked.withColumn("done", F.lit(0).cast("bigint")).drop("_n")


def sirt_reconstruct(rows: DataFrame, cfg: TomoConfig, root: str | None = None) -> Fired:
    """Reconstruct a bounded table of frame rows (row_id, seq, theta, center, ray)."""
    spark = rows.sparkSession
    root = root or scratch.new_folder(spark, "sirt")
    return fire(write_work(message_columns(rank_messages(rows, cfg)), cfg, f"{root}/work"), root, cfg)
