"""Running aggregates that do not put a whole key into one task.

A window over (key ordered by seq) sorts all rows of a key in one task, which
fails when one key holds a large part of the data. Here each key is cut into
blocks of its ordering column. The running value of a row is the total of the
earlier blocks of its key (a small table with one row per key and block)
combined with a window inside its own block.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


# Blocks whose totals are summed in one task where there are no keys.
BLOCKS = 1024
# Ranges of an order: rows in each, and how many of them there may be.
BLOCK_ROWS, LEAST_BLOCKS, MOST_BLOCKS = 1 << 20, 8, 4096
_FAN = 64


@dataclass(frozen=True)
class Running:
    """A running `kind` (sum, max, min) of `value`, with or without the own row."""

    value: Column
    kind: str
    own_row: bool = True
    total: str | None = None  # also add the key's total under this name


def block_of(order: Column, width: int) -> Column:
    return F.floor(order / F.lit(width)).cast("bigint")


def _number(df: DataFrame, name: str) -> Column:
    """An order column as a double that never falls while the column rises."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(name).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        seconds = F.hour(name) * 3600 + F.minute(name) * 60 + F.extract(F.lit("SECOND"), F.col(name)).cast("double")
        return (F.unix_date(F.col(name).cast("date")).cast("double") * 86400 + seconds) * 1e6
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    if isinstance(kind, T.NumericType):
        return F.col(name).cast("double")
    raise TypeError(f"{name} is of type {kind.simpleString()}: blocks without a given column need an order by numbers, dates or times")


def _rank(x: Column, cuts: list[float]) -> Column:
    """How many of the sorted cuts are at or below x: a tree of comparisons over every 64th, then a count within 64."""
    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x >= coarse[mid], tree(mid + 1, hi)).otherwise(tree(lo, mid))

    coarse = cuts[_FAN - 1::_FAN]
    fine = F.array(*[F.array(*map(F.lit, cuts[k:k + _FAN - 1])).cast("array<double>") for k in range(0, len(cuts) + 1, _FAN)])
    part = tree(0, len(coarse))
    return F.when(x.isNull(), 0).otherwise(part * _FAN + F.size(F.filter(F.element_at(fine, part + 1), lambda c: c <= x)))


def range_blocks(df: DataFrame, order: list[str]) -> DataFrame:
    """`df` with `_blk`, which never falls while the order rises: ranges of about equal size, BLOCK_ROWS if that makes no more than MOST_BLOCKS.

    The borders are quantiles of the first order column, from one pass that
    keeps a sketch; where one value takes more than a range, quantiles of the
    second column among its rows part it. They are constants of the expression:
    `_blk` is the same whenever rows are read again, and nothing is written.
    Nulls come first. Rows of one key that are equal in both columns stay
    together.
    """
    x = _number(df, order[0])
    n = df.count()
    blocks = max(LEAST_BLOCKS, min(MOST_BLOCKS, n // BLOCK_ROWS))

    def steps(many: int) -> list[float]:
        return [k / many for k in range(1, many)]

    found = df.agg(F.percentile_approx(x, steps(blocks), 20 * blocks).alias("q")).first()["q"] or []
    cuts = sorted(set(found))
    often = {v: k for v, k in Counter(found).items() if k > 1 and abs(v) < 2**53}
    if len(order) == 1 or not often or isinstance(df.schema[order[0]].dataType, T.DecimalType):
        return df.withColumn("_blk", _rank(x, cuts).cast("bigint"))
    most, y = max(often.values()) + 1, _number(df, order[1])
    parts = df.where(x.isin(*often)).groupBy(x.alias("v")).agg(F.percentile_approx(y, steps(most), 20 * most).alias("q")).collect()
    lists = F.create_map(*[e for r in parts for e in (F.lit(r["v"]), F.array(*map(F.lit, sorted(set(r["q"] or [])))).cast("array<double>"))])
    own = F.element_at(lists, x)
    # a value with ranges of its own comes before the others above its border
    inner = F.when(own.isNull(), 0).otherwise(F.size(F.filter(own, lambda c: c <= y)) - most)
    return df.withColumn("_blk", _rank(x, cuts).cast("bigint") * (most + 1) + inner)


def running(df: DataFrame, keys: list[str], order: list[str], block: Column | None,
            outs: dict[str, Running]) -> DataFrame:
    """Add the columns of `outs`, running over `order` within `keys`.

    `block` must not fall while `order` rises, and rows of one key and block
    must fit one task: right for unique sequence numbers, whose blocks have a
    largest size. Without it, blocks are cut by `range_blocks`.
    `keys` may be empty and must not contain nulls.
    """
    blk, group = "_blk", [*keys, "_blk"]
    rows = range_blocks(df, order) if block is None else df.withColumn(blk, block)

    totals = rows.groupBy(*group).agg(
        *[_AGG[r.kind](r.value).alias(f"_t_{name}") for name, r in outs.items()])
    if not keys:
        carry = _carried_without_keys(totals, outs)
    else:
        carry = _carried(totals, keys, outs)

    inside = Window.partitionBy(*group).orderBy(*order)
    for name, r in outs.items():
        frame = inside.rowsBetween(Window.unboundedPreceding, 0 if r.own_row else -1)
        rows = rows.withColumn(name, _AGG[r.kind](r.value).over(frame))
    rows = rows.join(carry, group)
    for name, r in outs.items():
        rows = rows.withColumn(name, _combine(r.kind, F.col(name), F.col(f"_c_{name}")))
    return rows.drop(blk, *[f"_c_{name}" for name in outs])


def _carried(totals: DataFrame, keys: list[str], outs: dict[str, Running]) -> DataFrame:
    """For each key and block what the key's earlier blocks hold: a window over block totals."""
    before = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carried = []
    for name, r in outs.items():
        agg = _AGG[r.kind]
        carried.append(agg(f"_t_{name}").over(before).alias(f"_c_{name}"))
        if r.total:
            carried.append(agg(f"_t_{name}").over(whole).alias(r.total))
    return totals.select(*keys, "_blk", *carried)


def _carried_without_keys(totals: DataFrame, outs: dict[str, Running]) -> DataFrame:
    """The same when all rows are one sequence: its blocks are put into blocks in turn, so that no task sees all their totals."""
    if any(r.total for r in outs.values()):
        raise ValueError("a total needs keys")
    line = totals.select(F.lit(0).alias("_all"), F.col("_blk").alias("_at"), *[f"_t_{name}" for name in outs])
    sums = {f"_c_{name}": Running(F.col(f"_t_{name}"), r.kind, own_row=False) for name, r in outs.items()}
    done = running(line, ["_all"], ["_at"], block_of(F.col("_at"), BLOCKS), sums)
    return done.select(F.col("_at").alias("_blk"), *sums)


def _combine(kind: str, here: Column, before: Column) -> Column:
    if kind == "sum":
        return F.coalesce(here, F.lit(0)) + F.coalesce(before, F.lit(0))
    return (F.greatest if kind == "max" else F.least)(here, before)


def keyed_rank(df: DataFrame, keys: list[str], order: list[str], block: Column | None = None,
               out: str = "rn", total: str | None = None) -> DataFrame:
    """Add the 1-based row number `out` per key, and the key's row count."""
    one = Running(F.lit(1).cast("bigint"), "sum", total=total)
    return running(df, keys, order, block, {out: one})
