"""Views that give the local tables the shapes of the operators' inputs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sinogrid.operators import records
from sinogrid.sources.frames import ITYPES

ROWS = 10  # detector rows that the vectors are dealt out to
SIDE = 8  # a vector of 64 values seen as an 8 x 8 image


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def kv(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").selectExpr(
        "event_id AS seq", "concat('key', user_id % 20) AS key",
        "cast(floor(value) AS INT) % 10 AS val")


def kv_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Many keys; lines of one order have no unique number, so seq is theirs only in part."""
    return table(spark, folder, "lineitem").selectExpr(
        "l_orderkey AS seq", "concat('key', l_partkey) AS key", "l_linenumber AS val")


def frames_per_row(spark: SparkSession, folder: str) -> int:
    return table(spark, folder, "embeddings").count() // ROWS


def frames(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """Detector rows. `spread` deals them to all tasks, for work that grows per sample."""
    step = math.pi / frames_per_row(spark, folder)
    vectors = table(spark, folder, "embeddings")
    if spread:
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        vectors = vectors.repartition(parts, "vec_id")
    return vectors.selectExpr(*frame_columns(step))


def frame_columns(angle_step: float) -> list[str]:
    return [f"vec_id % {ROWS} AS row_id", f"vec_id div {ROWS} AS projection_id",
            f"vec_id div {ROWS} + 1 AS seq", f"(vec_id div {ROWS} + 0.37D) * {angle_step!r}D AS theta",
            "0D AS center", "embedding AS ray"]


def images(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").selectExpr(
        "vec_id AS seq", "vec_id AS unique_id", "cast(1 AS TINYINT) AS itype",
        "vec_id * 0.01D AS theta", "0D AS center", f"{SIDE} AS ny", f"{SIDE} AS nx", "embedding AS data")


def frames_calib(spark: SparkSession, folder: str) -> DataFrame:
    """Frames with two white and two dark frames after a reset in every 25."""
    code = F.lit(ITYPES["Projection"])
    for at, name in ((0, "WhiteReset"), (1, "White"), (2, "White"), (3, "DarkReset"), (4, "Dark")):
        code = F.when(F.col("projection_id") % 25 == at, ITYPES[name]).otherwise(code)
    df = frames(spark, folder).withColumn("itype", code.cast("tinyint"))
    ray = ("transform(ray, x -> cast(CASE WHEN itype IN (2, 4) THEN abs(cast(x AS DOUBLE)) + 2D "
           "WHEN itype IN (3, 5) THEN abs(cast(x AS DOUBLE)) * 0.1D ELSE abs(cast(x AS DOUBLE)) END AS FLOAT))")
    return df.withColumn("ray", F.expr(ray))


def samples_dirty(spark: SparkSession, folder: str) -> DataFrame:
    """Long form with NaN, infinities, zeros and subnormals in fixed places."""
    return (frames(spark, folder).selectExpr("row_id", "projection_id", "posexplode(ray) AS (pix, x)")
            .selectExpr("row_id", "projection_id", "pix",
                        "CASE pix % 8 WHEN 0 THEN cast('NaN' AS FLOAT) WHEN 1 THEN cast('Infinity' AS FLOAT) "
                        "WHEN 2 THEN cast('-Infinity' AS FLOAT) WHEN 3 THEN cast(0 AS FLOAT) "
                        "WHEN 4 THEN cast(1e-40 AS FLOAT) ELSE x END AS x"))


def arrivals(spark: SparkSession, folder: str) -> DataFrame:
    """Messages per user in the order (ts, event_id); their seq does not rise steadily."""
    return table(spark, folder, "events").selectExpr(
        "user_id AS row_id", "event_id", "ts", "cast(floor(value) AS BIGINT) AS seq",
        "value * 0.01D AS theta", "value AS center",
        "CASE WHEN event_id % 97 = 0 THEN 'FIN' ELSE 'DATA' END AS kind")


ARRIVAL_ORDER = ["ts", "event_id"]


def bad_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Checksummed frames of which some lack ids, have a wrong length or checksum."""
    rows = records.with_checksum(frames(spark, folder))
    rows = rows.withColumn("_m", F.expr(f"(projection_id * {ROWS} + row_id) % 17"))
    rows = rows.withColumn("row_id", F.expr("IF(_m = 0, NULL, row_id)"))
    rows = rows.withColumn("ray", F.expr(
        "CASE _m WHEN 1 THEN slice(ray, 1, 63) WHEN 2 THEN slice(ray, 1, 0) ELSE ray END"))
    return rows.withColumn("checksum", F.expr("IF(_m = 3, checksum + 1, checksum)")).drop("_m")
