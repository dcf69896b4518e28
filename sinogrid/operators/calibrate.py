"""White and dark calibration sets and the normalisation of projections.

Calibration frames take effect in sequence order. A reset frame empties its set
and becomes its first member. A projection uses the mean of all members present
when it arrives.

Levels are running sums over whole rays, in two steps. Calibration frames of a
block (a range of sequence numbers of a row id) are read in order by one task,
which keeps one sum per set; the sums at the ends of the blocks are then carried
from block to block. What holds from one calibration frame to the next is an
interval, cut where a block ends. A projection finds its interval by one join on
row id and block with a condition on its number, and is moved once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinogrid import scratch
from sinogrid.config import TomoConfig
from sinogrid.functions import cleaning
from sinogrid.operators.blocked import block_of
from sinogrid.sources.frames import ITYPES

# Frame types of each set, the one that resets it last.
SETS = {"white": ("White", "WhiteReset"), "dark": ("Dark", "DarkReset")}

BLOCK = 1024
# What follows the last block with a calibration frame is dealt to so many keys per row id.
TAILS = 64
_FIRST = -(2**63)

_STATE = ", ".join(f"{name}_reset boolean, {name}_n long, {name}_sum array<double>" for name in SETS)
_SUMS = f"row_id long, block long, seq long, until long, first long, itype int, last boolean, {_STATE}"
_CARRY = f"row_id long, block long, since long, first long, {_STATE}"


def _names(schema: str) -> list[str]:
    return [field.split()[0] for field in schema.split(", ")]


class _Levels:
    """Per set: whether a reset was seen, the number of members, and their sum."""

    def __init__(self):
        self.sets = [(False, 0, np.zeros(0)) for _ in SETS]

    def add(self, which: int, reset: bool, members: int, total: np.ndarray) -> None:
        was_reset, n, before = self.sets[which]
        if reset or not n:
            self.sets[which] = (reset or was_reset, members, total)
        elif members:
            if len(before) != len(total):
                raise ValueError(f"calibration rays of {len(before)} and {len(total)} samples in one row id")
            self.sets[which] = (was_reset, n + members, before + total)

    def fields(self) -> list:
        return [x for one in self.sets for x in one]


_KINDS = {ITYPES[name]: (k, name == names[-1]) for k, names in enumerate(SETS.values()) for name in names}


def _record_batch(rows: list[list], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
    types = [kinds[field.split()[1]] for field in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=_names(schema))


def _block_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets after each calibration frame, from the start of its block; rows come sorted by row id, block and number.

    A frame without samples is no member; as a reset it empties its set.
    """
    key, held, first = None, None, None
    for batch in batches:
        out, rays = [], batch.column("ray")
        bounds, samples = rays.offsets.to_numpy(), rays.values.to_numpy(zero_copy_only=False)
        for k, (row_id, block, seq, itype) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row_id", "block", "seq", "itype")))):
            if held is not None:
                out.append([*held[:3], seq if key == (row_id, block) else None, *held[3:5], key != (row_id, block), *held[5]])
            if key != (row_id, block):
                key, first, levels = (row_id, block), seq, _Levels()
            which, reset = _KINDS[itype]
            ray = samples[bounds[k]:bounds[k + 1]]
            levels.add(which, reset, int(len(ray) > 0), ray)
            held = (row_id, block, seq, first, itype, levels.fields())
        if out:
            yield _record_batch(out, _SUMS)
    if held is not None:
        yield _record_batch([[*held[:3], None, *held[3:5], True, *held[5]]], _SUMS)


def _carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sets before each block and, with a null block, after the last one of a row id."""
    now, since, levels = None, None, None
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            if now != row["row_id"]:
                if since is not None:
                    out.append([now, None, since, None, *levels.fields()])
                now, since, levels = row["row_id"], None, _Levels()
            out.append([now, row["block"], since, row["first"], *levels.fields()])
            for which, name in enumerate(SETS):
                levels.add(which, row[f"{name}_reset"], row[f"{name}_n"], np.array(row[f"{name}_sum"], float))
            since = row["block"]
        if out:
            yield _record_batch(out, _CARRY)
    if since is not None:
        yield _record_batch([[now, None, since, None, *levels.fields()]], _CARRY)


def _block_table(frames: DataFrame, block_width: int, path: str | None) -> DataFrame:
    """`_block_sums` of the calibration frames, written out: three further steps read it."""
    calib = frames.where(F.col("itype").isin(*_KINDS)).select(
        F.col("row_id").cast("long"), block_of(F.col("seq"), block_width).alias("block"), F.col("seq").cast("long"),
        F.col("itype").cast("int"), F.col("ray").cast("array<double>"))
    sums = calib.repartition("row_id", "block").sortWithinPartitions("row_id", "block", "seq").mapInArrow(_block_sums, _SUMS)
    path = path or scratch.new_folder(frames.sparkSession, "levels")
    sums.write.mode("overwrite").parquet(path)
    return frames.sparkSession.read.schema(sums.schema).parquet(path)


def _carry(table: DataFrame) -> DataFrame:
    ends = table.where("last").select("row_id", "block", "first", *_names(_STATE))
    return ends.repartition("row_id").sortWithinPartitions("row_id", "block").mapInArrow(_carried, _CARRY)


def _mean(total: Column, members: Column) -> Column:
    return F.when(members > 0, F.transform(total, lambda x: x / members))


def _after_frames(table: DataFrame, carry: DataFrame) -> DataFrame:
    """Each calibration frame with the means of both sets after it."""
    before = carry.where("block IS NOT NULL").select("row_id", "block", *[F.col(c).alias(f"_{c}") for c in _names(_STATE) if not c.endswith("reset")])
    rows = table.join(before, ["row_id", "block"])
    for name in SETS:
        alone = F.col(f"{name}_reset") | (F.col(f"_{name}_n") == 0)
        total = (F.when(alone, F.col(f"{name}_sum")).when(F.col(f"{name}_n") == 0, F.col(f"_{name}_sum"))
                 .otherwise(F.zip_with(f"{name}_sum", f"_{name}_sum", lambda x, y: y + x)))
        members = F.when(alone, F.col(f"{name}_n")).otherwise(F.col(f"{name}_n") + F.col(f"_{name}_n"))
        rows = rows.withColumn(name, _mean(total, members))
    return rows.select("row_id", "block", "seq", "until", "itype", *SETS)


def calibration_sets(frames: DataFrame, block_width: int = BLOCK, path: str | None = None) -> DataFrame:
    """Mean of a set after each of its frames, one row per sample position.

    Only calibration frames are read, and moved as whole rays. `path` names the
    intermediate table, which otherwise lies in the shared folder.
    """
    table = _block_table(frames, block_width, path)
    rows = _after_frames(table, _carry(table))
    white = F.col("itype").isin(*[ITYPES[n] for n in SETS["white"]])
    return rows.select("row_id", F.when(white, "white").otherwise("dark").alias("set"), "seq",
                       F.posexplode(F.when(white, F.col("white")).otherwise(F.col("dark"))).alias("pix", "mean"))


def calibration_intervals(table: DataFrame, last_block: int) -> DataFrame:
    """(row_id, key, from, until, white, dark): what holds for numbers from `from` up to before `until` (null: no end) in a block.

    Keys are block numbers up to `last_block`, the last one with a calibration
    frame; what a row id has beyond holds under each of the keys -1 to -TAILS.
    """
    carry = _carry(table)
    own = _after_frames(table, carry).select("row_id", F.col("block").alias("key"), F.col("seq").alias("from"), "until", *SETS)
    tails = F.sequence(F.lit(-TAILS).cast("long"), F.lit(-1).cast("long"))
    after, end = F.col("since") + 1, F.coalesce("block", F.lit(last_block))
    keys = F.when(after <= end, F.sequence(after, end)).otherwise(F.array().cast("array<bigint>"))
    keys = F.when(F.col("block").isNull(), F.concat(keys, tails)).otherwise(keys)
    means = [_mean(F.col(f"{name}_sum"), F.col(f"{name}_n")).alias(name) for name in SETS]
    carried = carry.where("since IS NOT NULL").select("row_id", "block", "first", F.explode(keys).alias("key"), *means).select(
        "row_id", "key", F.lit(_FIRST).alias("from"), F.when(F.col("key") == F.col("block"), F.col("first")).alias("until"), *SETS)
    return own.unionByName(carried)


def normalize(frames: DataFrame, block_width: int = BLOCK, path: str | None = None) -> DataFrame:
    """Projections with `ray` normalised; unchanged while a set is empty.

    Calibration frames and projections are each read once. `path` names the
    table of the sets, which otherwise lies in the shared folder.
    """
    table = _block_table(frames, block_width, path)
    rows = frames.where(F.col("itype") == ITYPES["Projection"])
    last = table.agg(F.max("block")).first()[0]
    if last is None:
        return rows.withColumn("ray", F.col("ray").cast("array<double>"))
    block = block_of(F.col("seq"), block_width)
    key = F.when(block <= last, block).otherwise(-1 - F.pmod(block, F.lit(TAILS)))
    levels = calibration_intervals(table, last).withColumnRenamed("row_id", "_row")
    holds = (F.col("seq") >= F.col("from")) & (F.col("until").isNull() | (F.col("seq") < F.col("until")))
    rows = rows.withColumn("_key", key).join(
        levels, (F.col("row_id") == F.col("_row")) & (F.col("_key") == F.col("key")) & holds, "left")
    sample = lambda t: cleaning.flat_dark(t["x"].cast("double"), t["w"], t["d"])
    corrected = F.transform(F.arrays_zip(F.col("ray").alias("x"), F.col("white").alias("w"), F.col("dark").alias("d")), sample)
    ready = F.col("white").isNotNull() & F.col("dark").isNotNull()
    ray = F.when(ready, corrected).otherwise(F.col("ray").cast("array<double>"))
    return rows.select(*[ray.alias(c) if c == "ray" else F.col(c) for c in frames.columns])


def calibrate(frames: DataFrame, cfg: TomoConfig, path: str | None = None) -> DataFrame:
    """The cleaning steps that `cfg` switches on; only projections go on."""
    kind = "uint8" if cfg.uint8_to_float32 else "uint16" if cfg.uint16_to_float32 else "float32" if cfg.cast_to_float32 else None
    if kind:
        frames = cleaning.to_float_ray(frames, "ray", kind)
    if cfg.normalize:
        rows = normalize(frames, path=path)
    else:
        rows = frames.where(F.col("itype") == ITYPES["Projection"])
    if cfg.degree_to_radian:
        rows = rows.withColumn("theta", F.radians("theta"))
    rules = []
    if cfg.mlog:
        rules.append(cleaning.minus_log)
    if cfg.remove_invalids:
        rules.append(cleaning.remove_invalids)
    if rules:
        rows = rows.withColumn("ray", cleaning.on_ray(F.col("ray"), _chain(rules)))
    return rows


def _chain(rules):
    def apply(x: Column) -> Column:
        for rule in rules:
            x = rule(x)
        return x
    return apply
