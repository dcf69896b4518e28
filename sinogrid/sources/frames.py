"""Detector frames: scans, typing, tiling, replay and lookups.

Two layouts are used. An image table holds one frame per row
(seq, unique_id, itype, theta, center, ny, nx, data ARRAY<FLOAT>). A frame-row
table holds one detector row of a frame per row
(row_id, seq, projection_id, theta, center, ray ARRAY<FLOAT>).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sinogrid.operators.blocked import Running, block_of, running

# Frame type codes.
ITYPES = {
    "End": 0,
    "Projection": 1,
    "White": 2,
    "Dark": 3,
    "WhiteReset": 4,
    "DarkReset": 5,
}


# Subsets of a row id whose frames are numbered together.
SUBSETS_A_BLOCK = 4096


def itype_label(itype: Column) -> Column:
    label = F.lit(None).cast("string")
    for name, code in ITYPES.items():
        label = F.when(itype == code, name).otherwise(label)
    return label


def scan_frames(spark: SparkSession, path: str, angles_in: str = "radians",
                beg_row: int = 0, num_rows: int | None = None) -> DataFrame:
    """Frame rows from Parquet with float samples and the angle in both units."""
    return prepare_scan(spark.read.parquet(path), angles_in, beg_row, num_rows)


def prepare_scan(rows: DataFrame, angles_in: str = "radians",
                 beg_row: int = 0, num_rows: int | None = None) -> DataFrame:
    theta = F.col("theta").cast("double")
    radians = F.radians(theta) if angles_in == "degrees" else theta
    rows = rows.withColumn("ray", F.col("ray").cast("array<float>"))
    rows = rows.withColumn("theta", radians).withColumn("theta_deg", F.degrees("theta"))
    if beg_row or num_rows is not None:
        rows = read_slices(rows, beg_row, num_rows)
    return rows


def read_slices(rows: DataFrame, beg: int, count: int | None = None) -> DataFrame:
    """Detector rows [beg, beg + count) of all projections; reaches the scan as a filter."""
    rows = rows.where(F.col("row_id") >= beg)
    return rows if count is None else rows.where(F.col("row_id") < beg + count)


def read_projections(rows: DataFrame, beg: int, count: int) -> DataFrame:
    """All detector rows of projections [beg, beg + count)."""
    return rows.where((F.col("projection_id") >= beg) & (F.col("projection_id") < beg + count))


def dataset_stats(rows: DataFrame) -> DataFrame:
    """Dimensions and payload size.

    Ids are counted by grouping first, so no task holds a set of all ids.
    """
    per_projection = rows.groupBy("projection_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.size("ray").cast("bigint")).alias("samples"),
        F.min(F.size("ray")).alias("lo"), F.max(F.size("ray")).alias("hi"),
        F.min("row_id").alias("rlo"), F.max("row_id").alias("rhi"))
    return per_projection.agg(
        F.count(F.lit(1)).alias("projections"),
        F.min("projection_id").alias("first_projection"),
        F.max("projection_id").alias("last_projection"),
        F.min("rlo").alias("first_row"), F.max("rhi").alias("last_row"),
        F.min("lo").alias("min_columns"), F.max("hi").alias("max_columns"),
        F.sum("n").alias("messages"), (F.sum("samples") * 4).alias("bytes"))


def tile_rows(rows: DataFrame, num_sinograms: int, source_rows: int) -> DataFrame:
    """Repeat the row axis to `num_sinograms` rows; row j copies row j mod source_rows.

    Each source row lists its own copies, so nothing is joined or shuffled.
    """
    if num_sinograms <= source_rows:
        return rows
    copies = F.sequence(F.col("row_id").cast("bigint"), F.lit(num_sinograms - 1).cast("bigint"),
                        F.lit(source_rows).cast("bigint"))
    return rows.withColumn("row_id", F.explode(copies))


def sequence_frames(flats: DataFrame, darks: DataFrame, projections: DataFrame,
                    n_flats: int, n_darks: int) -> DataFrame:
    """One typed, consecutively numbered stream: flats, darks, then projections.

    Inputs carry `idx`, their position from 0. The first flat and the first dark
    reset their calibration set; calibration frames have angle 0.
    """
    def typed(frames: DataFrame, first: str, rest: str, offset: int, keep_angle: bool) -> DataFrame:
        code = F.when(F.col("idx") == 0, ITYPES[first]).otherwise(ITYPES[rest]).cast("tinyint")
        angle = F.col("theta").cast("double") if keep_angle else F.lit(0.0)
        number = (F.col("idx") + offset).cast("bigint")
        return (frames.withColumn("itype", code).withColumn("theta", angle)
                .withColumn("unique_id", number).withColumn("seq", number).drop("idx"))

    return (typed(flats, "WhiteReset", "White", 0, False)
            .unionByName(typed(darks, "DarkReset", "Dark", n_flats, False))
            .unionByName(typed(projections, "Projection", "Projection", n_flats + n_darks, True)))


def replay(frames: DataFrame, d_iteration: int, nmsgs: int) -> DataFrame:
    """Every frame once per iteration, with sequence numbers that go on rising.

    `seq` of the input is the position 0..nmsgs-1. Each frame lists its own
    repeats, so nothing is joined or shuffled.
    """
    out = frames.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(d_iteration - 1))))
    return out.withColumn("seq", F.col("seq") + F.col("iter").cast("bigint") * F.lit(nmsgs))


def tick_frames(ticks: DataFrame, frames: DataFrame, nmsgs: int) -> DataFrame:
    """Frame of each data tick: position (seq - 1) mod nmsgs, cyclically.

    An equi-join left to Catalyst, which broadcasts a side only under its
    size threshold. `frames.seq` is the position from 0.
    """
    frames = frames.withColumnRenamed("seq", "_pos")
    data = ticks.where(F.col("kind") == "DATA").withColumn("_pos", F.pmod(F.col("seq") - 1, F.lit(nmsgs)))
    return data.join(frames, "_pos").drop("_pos")


def cycle_frames(frames: DataFrame, nmsgs: int, projections: int, total: int) -> DataFrame:
    """`tick_frames` for all ticks 1..total: each frame lists its own ticks.

    Frames are not shuffled and no tick table is needed.
    """
    first = F.col("seq").cast("bigint") + 1
    ticks = F.when(first <= total, F.sequence(first, F.lit(total).cast("bigint"), F.lit(nmsgs).cast("bigint")))
    out = frames.withColumn("seq", F.explode(ticks))
    iteration = F.floor((F.col("seq") - 1) / F.lit(projections)).cast("int")
    return out.withColumn("iter", iteration).withColumn("kind", F.lit("DATA"))


def frames_in_reach(frames: DataFrame, ticks: DataFrame, nmsgs: int) -> DataFrame:
    """Frames at the positions between the first and last of a batch of ticks.

    A filter on the position that reaches the scan, so a small batch does not
    read the whole frame table.
    """
    span = ticks.agg(F.min("seq").alias("lo"), F.max("seq").alias("hi")).first()
    if span["lo"] is None or span["hi"] - span["lo"] + 1 >= nmsgs:
        return frames
    lo, hi = (span["lo"] - 1) % nmsgs, (span["hi"] - 1) % nmsgs
    if lo <= hi:
        return frames.where(F.col("seq").between(lo, hi))
    return frames.where((F.col("seq") >= lo) | (F.col("seq") <= hi))


def ordered_subset(frames: DataFrame, total: int, size: int = 16, index: str = "idx", keys: Sequence[str] = ("row_id",)) -> DataFrame:
    """Position of each frame of its row id when every ceil(total/size)-th frame is taken in turn.

    Positions are counted, so row ids may have more or fewer frames than `total`,
    and numbers may be missing or come twice.
    """
    subsets = -(-total // size)
    i = F.col(index).cast("bigint")
    # a struct, so that frames without a row id are a group like any other
    rows = frames.withColumn("subset", F.pmod(i, F.lit(subsets))).withColumn("_key", F.struct(*keys))
    one = Running(F.when(i.isNotNull(), 1).otherwise(0).cast("bigint"), "sum")
    block = F.coalesce(block_of(F.col("subset"), SUBSETS_A_BLOCK), F.lit(-1))
    rows = running(rows, ["_key"], ["subset", index], block, {"position": one})
    position = F.when(i.isNotNull(), F.col("position") - 1)
    return rows.select(*frames.columns, "subset", position.alias("position"))
