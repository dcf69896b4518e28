"""Record-level operators: splitting, control rows, validation, checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sinogrid.functions.cleaning import INF
from sinogrid.functions.geometry import frame_center
from sinogrid.functions.hashing import fnv1a_floats

CONTROL_KINDS = ("WARMUP", "FIN")


def split_control(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(control rows, data rows)."""
    control = F.col("kind").isin(*CONTROL_KINDS)
    return rows.where(control), rows.where(~control)


def per_row_id(control: DataFrame, num_sinograms: int) -> DataFrame:
    """One copy of each control row per row id."""
    return control.withColumn("row_id", F.explode(F.sequence(F.lit(0), F.lit(num_sinograms - 1))))


def part_bounds(rows: Column, parts: int, part: Column) -> tuple[Column, Column]:
    """Offset and size of one of `parts` nearly equal parts; the first ones take the rest."""
    base = F.floor(rows / F.lit(parts)).cast("int")
    rest = rows % parts
    size = base + F.when(part < rest, 1).otherwise(0)
    return (part * base + F.least(part, rest)).cast("int"), size.cast("int")


def split_rows_even(images: DataFrame, parts: int) -> DataFrame:
    """Cut each image into `parts` blocks of whole rows."""
    df = images.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    offset, size = part_bounds(F.col("ny"), parts, F.col("part"))
    df = df.withColumn("row_offset", offset).withColumn("rows", size)
    block = F.slice("data", F.col("row_offset") * F.col("nx") + 1, F.col("rows") * F.col("nx"))
    return df.withColumn("block", block).drop("data").where(F.col("rows") > 0)


def explode_rows(images: DataFrame, checksum: bool = False) -> DataFrame:
    """One message per detector row of each image."""
    df = images.withColumn("row_id", F.explode(F.sequence(F.lit(0), F.col("ny") - 1)))
    ray = F.slice("data", F.col("row_id") * F.col("nx") + 1, F.col("nx"))
    df = df.select(
        "row_id", "seq", F.col("unique_id").alias("projection_id"), "itype", "theta",
        F.expr(frame_center("center", "nx")).alias("center"), ray.alias("ray"))
    if not checksum:
        return df.withColumn("checksum", F.lit(0).cast("bigint"))
    return with_checksum(df)


def with_checksum(rows: DataFrame) -> DataFrame:
    return rows.withColumn("checksum", fnv1a_floats(F.col("ray")))


def verify_checksum(rows: DataFrame) -> DataFrame:
    """Add `actual` and `checksum_ok`; a stored 0 means that no check is wanted."""
    rows = rows.withColumn("actual", fnv1a_floats(F.col("ray")))
    return rows.withColumn("checksum_ok",
                           (F.col("checksum") == 0) | (F.col("checksum") == F.col("actual")))


REQUIRED = ("row_id", "seq", "projection_id", "theta", "center")


def reject_reason(nx: int) -> Column:
    """Why a message cannot be used, or NULL."""
    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | F.col(name).isNull()
    size = F.coalesce(F.size("ray"), F.lit(0))
    return (F.when(missing, "missing field")
            .when(size <= 0, "empty payload")
            .when(size != nx, "wrong length"))


def mark_rows(rows: DataFrame, nx: int) -> DataFrame:
    """Add `reason`, NULL for usable rows; one pass serves both outcomes."""
    return rows.withColumn("reason", reject_reason(nx))


def validate_rows(rows: DataFrame, nx: int, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(usable rows, rejected rows with `reason`). In strict mode a bad row fails the job."""
    rows = mark_rows(rows, nx)
    if strict:
        fail = F.raise_error(F.concat(F.lit("bad message: "), F.col("reason")))
        rows = rows.withColumn("reason", F.when(F.col("reason").isNotNull(), fail).cast("string"))
    return rows.where(F.col("reason").isNull()).drop("reason"), rows.where(F.col("reason").isNotNull())


def checked(rows: DataFrame, nx: int = 0, checksum: bool = False) -> tuple[DataFrame, DataFrame]:
    """The input check of the jobs, batch and stream: (usable rows, rejected rows with `reason`).

    Fields that a message has must be filled, and its payload must not be empty;
    with `nx` it must have that many samples. With `checksum` the sum that came
    with a message is verified, whatever `nx` is. Columns a message does not
    carry are not asked for.
    """
    missing = F.lit(False)
    for name in REQUIRED:
        if name in rows.columns:
            missing = missing | F.col(name).isNull()
    as_bytes = isinstance(rows.schema["ray"].dataType, T.BinaryType)
    size = F.coalesce(F.octet_length("ray") if as_bytes else F.size("ray"), F.lit(0))
    reason = F.when(missing, "missing field").when(size <= 0, "empty payload")
    if nx and as_bytes:
        reason = reason.when((size < nx) | (size % nx != 0), "wrong length")
    elif nx:
        reason = reason.when(size != nx, "wrong length")
    columns = rows.columns
    if checksum and "checksum" in columns:
        rows = verify_checksum(rows)
        reason = reason.when(~F.col("checksum_ok"), "wrong checksum")
    marked = rows.withColumn("reason", reason).select(*columns, "reason")
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def upper_map(df: DataFrame, column: str) -> DataFrame:
    return df.withColumn(column, F.upper(column))


def sanitize_report(samples: DataFrame, value: str = "x", keys: tuple[str, ...] = ()) -> DataFrame:
    """How many samples each repair rule would change, and the repaired sums."""
    from sinogrid.functions import cleaning as c

    x = F.col(value)
    count = lambda cond: F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")
    finite = lambda y: F.when(F.isnan(y) | (F.abs(y) == F.lit(INF)), F.lit(0.0)).otherwise(y.cast("double"))
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        count(~F.isnan(x) & (x < 0)).alias("negatives"),
        count(F.isnan(x)).alias("nans"),
        count(c.is_abnormal(x)).alias("abnormal"),
        F.sum(finite(c.absolute(x))).alias("sum_absolute"),
        F.sum(finite(c.negatives_to_zero(x))).alias("sum_nonnegative"),
        F.sum(finite(c.nan_to_zero(x))).alias("sum_without_nan"),
        F.sum(c.abnormal_to_zero(x).cast("double")).alias("sum_normal"))
