"""Hashes and checksums as Spark expressions.

32-bit unsigned values are held as BIGINT. Products of two 32-bit numbers
would leave the BIGINT range (an error in ANSI mode), so they are taken in two
16-bit halves.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Send this module's functions with the task, so workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MASK32 = 0xFFFFFFFF

# FNV-1a 32-bit offset basis and prime.
FNV_OFFSET = 0x811C9DC5
FNV_PRIME = 0x01000193

# Murmur3 32-bit multipliers, additive constant and block length.
MURMUR_C1 = 0xCC9E2D51
MURMUR_C2 = 0x1B873593
MURMUR_ADD = 0xE6546B64
MURMUR_F1 = 0x85EBCA6B
MURMUR_F2 = 0xC2B2AE35
MURMUR_LEN = 4

# Fixed value: seed with which Spark hashes the columns of a hash partitioning.
PARTITION_SEED = 42

# Fixed value: rounds of the record checksum.
CHECKSUM_ROUNDS = 1000


# -- 32-bit arithmetic ------------------------------------------------------

def _mul32(x: Column, factor: int) -> Column:
    high = F.shiftleft((x * F.lit(factor >> 16)).bitwiseAND(0xFFFF), 16)
    return (x * F.lit(factor & 0xFFFF) + high).bitwiseAND(F.lit(MASK32))


def _rot32(x: Column, left: int) -> Column:
    return F.shiftleft(x, left).bitwiseAND(F.lit(MASK32)).bitwiseOR(F.shiftright(x, 32 - left))


def _xorshift(x: Column, *shifts: int) -> Column:
    for s in shifts:
        x = x.bitwiseXOR(F.shiftright(x, s))
    return x


def _inverse32(factor: int) -> int:
    return pow(factor, -1, 2**32)


def _in_stages(df: DataFrame, source: str, out: str, steps) -> DataFrame:
    # One projection per step: every step reads its input several times, and a
    # single nested expression would double in size with each of them.
    df = df.withColumn(out, F.col(source).cast("bigint").bitwiseAND(F.lit(MASK32)))
    for step in steps:
        df = df.withColumn(out, step(F.col(out)))
    # A filter on the result would be pushed through the projections and nest
    # them after all; it is not pushed below a generator.
    return df.withColumn(out, F.explode(F.array(out)))


def with_murmur_u32(df: DataFrame, source: str, out: str) -> DataFrame:
    """Add `out`: Murmur3 (32 bit, seed 0) of the integer column `source`."""
    return _in_stages(df, source, out, [
        lambda k: _mul32(k, MURMUR_C1),
        lambda k: _rot32(k, 15),
        lambda k: _mul32(k, MURMUR_C2),
        lambda k: _rot32(k, 13),
        lambda k: (k * 5 + F.lit(MURMUR_ADD)).bitwiseAND(F.lit(MASK32)).bitwiseXOR(F.lit(MURMUR_LEN)),
        lambda k: _xorshift(k, 16),
        lambda k: _mul32(k, MURMUR_F1),
        lambda k: _xorshift(k, 13),
        lambda k: _mul32(k, MURMUR_F2),
        lambda k: _xorshift(k, 16),
    ])


def with_murmur_inv_u32(df: DataFrame, source: str, out: str, seed: int = 0) -> DataFrame:
    """Add `out`: the integer whose Murmur3 value is `source`."""
    return _in_stages(df, source, out, [
        lambda k: _xorshift(k, 16),
        lambda k: _mul32(k, _inverse32(MURMUR_F2)),
        lambda k: k.bitwiseXOR(F.shiftright(k, 13)).bitwiseXOR(F.shiftright(k, 26)),
        lambda k: _mul32(k, _inverse32(MURMUR_F1)),
        lambda k: _xorshift(k, 16).bitwiseXOR(F.lit(MURMUR_LEN)),
        lambda k: (k + F.lit(2**32 - MURMUR_ADD)).bitwiseAND(F.lit(MASK32)),
        lambda k: _mul32(k, _inverse32(5)),
        lambda k: _rot32(k, 32 - 13).bitwiseXOR(F.lit(seed)),
        lambda k: _mul32(k, _inverse32(MURMUR_C2)),
        lambda k: _rot32(k, 32 - 15),
        lambda k: _mul32(k, _inverse32(MURMUR_C1)),
    ])


# -- text -------------------------------------------------------------------

def _hex_units(text: Column, charset: str, digits: int) -> Column:
    """Code units of `text` in `charset` as an array of BIGINT."""
    coded = F.hex(F.encode(text, charset))
    last = F.greatest(F.length(coded) / digits, F.lit(1)).cast("int") - 1
    unit = lambda i: F.coalesce(
        F.conv(F.substring(coded, i * digits + 1, F.lit(digits)), 16, 10).cast("bigint"), F.lit(0))
    return F.when(F.length(coded) > 0, F.transform(F.sequence(F.lit(0), last), unit)).otherwise(
        F.array().cast("array<bigint>"))


def _ascii_units(text: Column) -> Column:
    return F.when(
        F.length(text) > 0,
        F.transform(F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
                    lambda i: F.ascii(F.substring(text, i, F.lit(1))).cast("bigint")),
    ).otherwise(F.array().cast("array<bigint>"))


def _units(text: Column, charset: str, digits: int) -> Column:
    pure_ascii = F.octet_length(text) == F.length(text)
    return F.when(pure_ascii, _ascii_units(text)).otherwise(_hex_units(text, charset, digits))


def java_hash(text: Column) -> Column:
    """The 31-polynomial string hash over UTF-16 code units, signed 32 bit."""
    h = F.aggregate(
        _units(text, "UTF-16BE", 4), F.lit(0).cast("bigint"),
        lambda acc, u: (acc * 31 + u).bitwiseAND(F.lit(MASK32)),
        lambda acc: F.when(acc >= 2**31, acc - F.lit(2**32)).otherwise(acc))
    return h.cast("int")


def fnv1a_text(text: Column) -> Column:
    """FNV-1a (32 bit) of the UTF-8 bytes of `text`."""
    return F.aggregate(
        _units(text, "UTF-8", 2), F.lit(FNV_OFFSET).cast("bigint"),
        lambda acc, u: (acc.bitwiseXOR(u) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(MASK32)))


def record_checksum(text: Column) -> Column:
    """CRC32 of `text`, then rounds of c = (c << 1) ^ (c >>> 3) on 64 bits.

    The rounds are linear over GF(2): the result is the XOR of one constant per
    set bit of the CRC, so no loop runs per record.
    """
    crc = F.crc32(F.encode(text, "UTF-8"))
    out = None
    for bit, constant in enumerate(_round_constants()):
        term = F.negative(F.shiftright(crc, bit).bitwiseAND(F.lit(1))).bitwiseAND(F.lit(constant))
        out = term if out is None else out.bitwiseXOR(term)
    return out


def _round_constants() -> list[int]:
    constants = []
    for bit in range(32):
        c = 1 << bit
        for _ in range(CHECKSUM_ROUNDS):
            c = ((c << 1) ^ (c >> 3)) & (2**64 - 1)
        constants.append(c - 2**64 if c >= 2**63 else c)
    return constants


# -- float payloads ---------------------------------------------------------

def _fnv_rows(rows: np.ndarray) -> np.ndarray:
    """FNV-1a of each row of a (rows, bytes) uint8 matrix, all rows at once."""
    h = np.full(len(rows), FNV_OFFSET, dtype=np.uint64)
    for column in np.ascontiguousarray(rows.T):
        h = ((h ^ column) * np.uint64(FNV_PRIME)) & np.uint64(MASK32)
    return h


@F.arrow_udf(T.LongType())
def fnv1a_floats(payload: pa.Array) -> pa.Array:
    """FNV-1a (32 bit) of a float array's little-endian bytes.

    Spark has no expression for the bits of a float, hence Arrow batches. The
    byte chain of one row is sequential, so the work is vectorised across rows
    of equal length.
    """
    sizes = payload.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    values = payload.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).astype("<f4")
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
    out = np.zeros(len(sizes), dtype=np.int64)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        block = values[starts[at][:, None] + np.arange(size)]
        out[at] = _fnv_rows(block.view(np.uint8).reshape(len(at), size * 4)).astype(np.int64)
    return pa.array(out, mask=payload.is_null().to_numpy(zero_copy_only=False))
