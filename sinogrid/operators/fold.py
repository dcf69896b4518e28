"""Passes over images of one tile, in order, by the task that holds the row id.

A pass begins from the image of the pass before, so the passes of a row id are a
sequence whatever they run on. An image of one tile gives each of them little
work, and a Spark job per pass would spend its time on starting jobs. Here Spark
deals the row ids out, sorts their messages by arrival number and hands them on
in Arrow batches; a task keeps one image and the messages that its next window
can reach. Row ids are independent and run in parallel.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinogrid.config import TomoConfig
from sinogrid.functions import geometry as g
from sinogrid.operators import routing

# Detector columns up to which a task works on whole images.
MOST_COLUMNS = 128
_HELD = 64  # images in an output batch
# Crossings of a window up to which a task keeps them (24 bytes each).
_TRACED = 1 << 22
OUT = "row_id BIGINT, tile INT, vals ARRAY<DOUBLE>, pass0 BIGINT, last BOOLEAN, step BIGINT"
_SCHEMA = pa.schema([("row_id", pa.int64()), ("tile", pa.int32()), ("vals", pa.list_(pa.float64())),
                     ("pass0", pa.int64()), ("last", pa.bool_()), ("step", pa.int64())])


def folded(work: DataFrame, start: DataFrame | None, cfg: TomoConfig, nx: int) -> DataFrame:
    """Images of the due passes that are emitted or the last of their row id; `step` counts from 1 in this run.

    `work` holds ranked messages (row_id, seq, theta, center, ray, rn, done,
    fired); `start` the images (row_id, vals) of row ids with earlier passes. An
    image goes before its messages, as number 0.
    """
    parts = int(work.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mid = g.kernel_center(g.frame_center("center", f"{nx}"), f"{nx}", cfg.center)
    steep, slope, _ = g.ray_line("theta", "0D", f"{nx}")
    rows = (work.where(F.col("fired") > F.col("done"))
            .selectExpr("row_id", "rn", "seq", "theta", f"{mid} AS mid", "cast(ray AS ARRAY<DOUBLE>) AS vals", "done", "fired")
            .selectExpr("*", steep).selectExpr("*", slope, "IF(steep, sin(theta), cos(theta)) AS across").drop("theta"))
    if start is not None:
        rows = rows.unionByName(start.selectExpr("row_id", "0L AS rn", "vals"), allowMissingColumns=True)
    placed = routing.place(rows.withColumn("_to", F.pmod("row_id", F.lit(parts))), parts, "_to").drop("_to") \
        if cfg.keying == "modulo" else rows.repartition(parts, "row_id")
    length, step, sweeps, freq, tile = cfg.window_length, cfg.window_step, cfg.window_iter, cfg.write_freq, cfg.tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, one = [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("row_id", "rn", "seq", "mid", "steep", "slope", "across", "done", "fired")]
            lists = batch.column("vals")
            for i, (row_id, rn, seq, mid, steep, slope, across, done, fired) in enumerate(zip(*columns)):
                if one is None or one.row_id != row_id:
                    one = _Row(row_id, nx, tile)
                values = lists[i].values
                if rn == 0:
                    one.begin(values)
                    continue
                one.messages.append(_Message(rn, seq, mid, steep, slope, across, values))
                if rn % step or not done < (k := rn // step) <= fired or not one.ready(done):
                    continue
                size = k * step if (k - 1) * step < length else max(length, step)
                window = [m for m in one.messages if m.rn > rn - size]
                for _ in range(sweeps):
                    one.sweep(window, mid)
                if k == fired or (k - 1) % freq == 0:
                    held.append((row_id, 0, one.image, k - 1, k == fired, k - done))
                if k * step >= length:  # later windows have a fixed reach
                    one.messages = [m for m in one.messages if m.rn > rn - max(length, step)]
            while len(held) >= _HELD:
                yield _batch(held[:_HELD])
                held = held[_HELD:]
        if held:
            yield _batch(held)

    return placed.sortWithinPartitions("row_id", "rn").mapInArrow(run, OUT)


def _batch(held: list[tuple]) -> pa.RecordBatch:
    ids, tiles, images, passes, last, steps = zip(*held)
    ends = np.cumsum([0, *map(len, images)]).astype(np.int32)
    values = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(images)))
    columns = [ids, tiles, values, passes, last, steps]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) if c is not values else c for c, f in zip(columns, _SCHEMA)], schema=_SCHEMA)


@dataclass
class _Message:
    rn: int
    seq: int | None
    mid: float
    steep: bool | None
    slope: float | None
    across: float | None
    values: pa.DoubleArray | None
    traced: tuple | None = None

    def rays(self, nx: int, tile: int, mid: float, keep: bool):
        """(column, cell, chord, squares summed per column) of all crossings.

        They depend on the centre alone, so the passes and sweeps whose windows
        hold the message trace it once if they `keep` them.
        """
        if self.traced is not None and self.traced[0] == mid:
            return self.traced[1]
        col, cell, chord = self.crossings(nx, tile, mid)
        out = col, cell, chord, np.bincount(col, chord * chord, nx)
        self.traced = (mid, out) if keep else None
        return out

    def crossings(self, nx: int, tile: int, mid: float):
        """(column, cell, chord) of all crossings: a ray meets at most two cells per strip."""
        at = np.arange(nx, dtype=float)
        offset = (1.0 - nx) / 2.0 + at + (nx / 2.0 - mid + g.GRID_SHIFT)
        icept = (-offset if self.steep else offset) / self.across + nx / 2.0 * (1.0 - self.slope)
        ends = self.slope * at + icept[:, None], self.slope * (at + 1.0) + icept[:, None]
        bottom, top = np.minimum(*ends), np.maximum(*ends)
        # the cell of an undefined line is 0, as in a cast
        low, high = np.floor(bottom), np.floor(top)
        if np.isnan(bottom).any():
            low, high = (np.nan_to_num(x, nan=0.0) for x in (low, high))
        apart, chord = low != high, np.sqrt(1.0 + self.slope * self.slope)
        out = []
        for cell, ok in ((low, (low >= 0) & (low < nx)), (high, apart & (high >= 0) & (high < nx))):
            found = np.flatnonzero(ok)
            col, strip = np.divmod(found, nx)
            cell, parted, b, t = (x.ravel()[found] for x in (cell, apart, bottom, top))
            part = (np.minimum(t, cell + 1.0) - np.maximum(b, cell)) / np.where(parted, t - b, 1.0)
            share = np.where(parted, part, 1.0)
            cell = cell.astype(np.int64)
            out.append((col, cell + strip * tile if self.steep else strip + cell * tile, share * chord))
        return tuple(np.concatenate(x) for x in zip(*out))


@dataclass
class _Row:
    """The image of a row id and the messages that its next window can reach."""

    row_id: int | None
    nx: int
    tile: int
    image: np.ndarray | None = None
    messages: list[_Message] = field(default_factory=list)

    def begin(self, values) -> None:
        self.image = values.to_numpy(zero_copy_only=False).copy()

    def ready(self, done: int) -> bool:
        if done == 0 and self.image is None:
            self.image = np.zeros(self.tile * self.tile)
        return self.image is not None

    def sweep(self, window: list[_Message], mid: float) -> None:
        """One sweep, as `sirt.sweep`: messages of one number are one message."""
        nx, cells = self.nx, self.tile * self.tile
        num, den = np.zeros(cells), np.zeros(cells)
        keep = 2 * nx * nx * len(window) <= _TRACED
        same: dict[int | None, list[_Message]] = {}
        for m in window:
            if m.values is not None and m.slope is not None and mid is not None:
                same.setdefault(m.seq, []).append(m)
        with np.errstate(all="ignore"):
            for copies in same.values():
                sim, norm = np.zeros(nx), np.zeros(nx)
                for m in reversed(copies):  # the first one's crossings are left for the way back
                    col, cell, chord, squares = m.rays(nx, self.tile, mid, keep)
                    sim += np.bincount(col, self.image[cell] * chord, nx)
                    norm += squares
                values = copies[0].values
                change = np.where(norm != 0, (values.to_numpy(zero_copy_only=False) - sim) / norm, 0.0)
                if values.null_count:  # a missing sample changes nothing, one that is NaN makes its cells undefined
                    change[values.is_null().to_numpy(zero_copy_only=False)] = 0.0
                num += np.bincount(cell, chord * change[col], cells)
                den += np.bincount(cell, chord, cells)
            self.image = self.image + np.nan_to_num(np.where(den != 0, num / den, 0.0), nan=0.0, posinf=np.inf, neginf=-np.inf)
