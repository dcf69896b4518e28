"""Sample-level calibration and cleaning rules.

Every rule takes and returns one sample; `on_ray` applies it to an array.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: smallest allowed difference of white and dark level.
MIN_RANGE = 1e-6
# Fixed value: smallest normal float32.
SMALLEST_NORMAL = 1.17549435e-38

INF = float("inf")
NAN = float("nan")


def on_ray(ray: Column, rule: Callable[[Column], Column]) -> Column:
    return F.transform(ray, rule)


# Sample kinds of a payload and their little-endian layout.
LAYOUT = {"uint8": "<u1", "uint16": "<u2", "float32": "<f4"}


def _from_bytes(kind: str):
    @F.arrow_udf("array<float>")
    def read(payload: pa.Array) -> pa.Array:
        width = np.dtype(LAYOUT[kind]).itemsize
        rows = [None if b is None or len(b) % width else np.frombuffer(b, LAYOUT[kind]).astype(np.float32) for b in payload.to_pylist()]
        return pa.array(rows, pa.list_(pa.float32()))

    return read


def to_float_ray(df: DataFrame, column: str, kind: str) -> DataFrame:
    """`df` with the payload `column` read as samples of `kind`, as float32.

    Bytes are cut into little-endian samples; a length that is no whole number
    of them gives NULL. Signed integers hold the bits of unsigned ones. Samples
    that are floats already stay as they are.
    """
    held, payload = df.schema[column].dataType, F.col(column)
    if isinstance(held, T.BinaryType):
        ray = _from_bytes(kind)(payload)
    elif kind != "float32" and isinstance(held.elementType, T.IntegralType):
        mask = F.lit(255 if kind == "uint8" else 65535)
        ray = F.transform(payload, lambda x: x.cast("int").bitwiseAND(mask).cast("float"))
    else:
        ray = payload.cast("array<float>")
    return df.withColumn(column, ray)


def flat_dark(x: Column, white: Column, dark: Column) -> Column:
    return (x - dark) / F.greatest(white - dark, F.lit(MIN_RANGE))


def minus_log(x: Column) -> Column:
    # Spark's ln is NULL for x <= 0; IEEE semantics are wanted here.
    return F.when(x > 0, -F.ln(x)).when(x == 0, F.lit(INF)).otherwise(F.lit(NAN))


def is_invalid(x: Column) -> Column:
    return F.isnan(x) | (x < 0) | (x == F.lit(INF))


def remove_invalids(x: Column) -> Column:
    return F.when(is_invalid(x), F.lit(0.0)).otherwise(x)


def is_abnormal(x: Column) -> Column:
    """NaN, infinite, subnormal or zero."""
    return F.isnan(x) | (F.abs(x) == F.lit(INF)) | (F.abs(x) < F.lit(SMALLEST_NORMAL))


def absolute(x: Column) -> Column:
    return F.abs(x)


def negatives_to_zero(x: Column) -> Column:
    return F.when(x < 0, F.lit(0.0)).otherwise(x)


def nan_to_zero(x: Column) -> Column:
    return F.when(F.isnan(x), F.lit(0.0)).otherwise(x)


def abnormal_to_zero(x: Column) -> Column:
    return F.when(is_abnormal(x), F.lit(0.0)).otherwise(x)
