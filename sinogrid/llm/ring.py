"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations alone.

Every shard owns `vnodes` points of a ring of 2**ring_bits cells, and a key
belongs to the first point at or after its cell. A shard takes its own keys up
to its capacity; each key beyond it goes on clockwise to the next point whose
shard has room left. Loads are summed per cell first, so that what passes along
the ring is worked out on a table of at most 2**ring_bits rows, however many
keys there are:

- an overfull shard sheds its surplus from its points in proportion to their keys,
- a shard with room offers it at its points in proportion to their arcs,
- with o surplus keys and r free places in ring order, the keys under way behind
  point i are S_i - min(S_j, j <= i), S the running sum of o - r, started behind
  the minimum of S, where nothing is under way. The k-th surplus key takes the
  k-th place that is used.

Only surplus keys leave their shard, and those are as few as any assignment of
this balance allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinogrid.llm.tables import stored


def _cell(text: Column, ring_bits: int) -> Column:
    """Place on the ring: the leading bits of an MD5."""
    word = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")
    return F.shiftright(word, 32 - ring_bits)


def points(spark, shards: int, vnodes: int, ring_bits: int) -> DataFrame:
    """(vnode, cell, shard): all points in ring order; ties go by shard, then number."""
    order = Window.orderBy("cell", "shard", "replica")
    return (spark.range(shards * vnodes)
            .select((F.col("id") % shards).cast("int").alias("shard"), F.floor(F.col("id") / shards).cast("int").alias("replica"))
            .withColumn("cell", _cell(F.format_string("shard-%d-%d", "shard", "replica"), ring_bits))
            .select((F.row_number().over(order) - 1).alias("vnode"), "cell", "shard"))


def _owners(nodes: DataFrame, ring_bits: int) -> DataFrame:
    """(cell, vnode, shard) for every cell: the first point at or after it, round the end."""
    spark = nodes.sparkSession
    first = nodes.groupBy("cell").agg(F.min("vnode").alias("vnode"))
    ahead = Window.orderBy(F.desc("cell")).rowsBetween(Window.unboundedPreceding, 0)
    ring = (spark.range(2**ring_bits).select(F.col("id").alias("cell")).join(first, "cell", "left")
            .withColumn("vnode", F.coalesce(F.last("vnode", True).over(ahead), F.lit(0))))
    return ring.join(F.broadcast(nodes.select("vnode", "shard")), "vnode")


def assign(rows: DataFrame, key: str, tie: list[str], shards: int = 24, vnodes: int = 128, load: float | None = None,
           ring_bits: int = 16) -> DataFrame:
    """`rows` with shard and slot (gapless from 0 within a shard).

    load: capacity of a shard as a multiple of the mean (1.25: a quarter above
    it). None: as even as can be, counts differ by one at most.

    Any key type with a text form; null keys form one key. Equal keys and equal
    rows share a cell, their order there goes by `tie`, and full ties are
    interchangeable. No rows give no rows; further columns of `rows` pass
    through, and the columns added are named shard and slot (rows must not have them).
    """
    spark = rows.sparkSession
    placed = rows.withColumn("_cell", _cell(F.coalesce(F.col(key).cast("string"), F.lit("")), ring_bits))
    owners = _owners(points(spark, shards, vnodes, ring_bits), ring_bits)
    # one row per cell: its keys, its point, its shard
    cells = stored(placed.groupBy("_cell").agg(F.count("*").alias("n")).withColumnRenamed("_cell", "cell")
                   .join(owners, "cell", "right").fillna(0, ["n"]), "ring")
    total = cells.agg(F.sum("n")).first()[0]
    if load is None:
        capacity = F.lit(total // shards) + F.when(F.col("shard") < total % shards, 1).otherwise(0)
    else:
        capacity = F.lit(-int(-total * load // shards))
    by_shard, in_shard = Window.partitionBy("shard"), Window.partitionBy("shard").orderBy("cell")
    before = in_shard.rowsBetween(Window.unboundedPreceding, -1)

    def share(amount: Column, weight: str) -> Column:
        """`amount` of a shard over its cells by weight, in whole numbers without loss."""
        all_of, upto = F.sum(weight).over(by_shard), F.sum(weight).over(in_shard)
        less = F.coalesce(F.sum(weight).over(before), F.lit(0))
        return F.when(all_of == 0, 0).otherwise(F.call_function("div", amount * upto, all_of) - F.call_function("div", amount * less, all_of)).cast("long")

    home = F.sum("n").over(by_shard)
    flow = (cells.withColumn("cap", capacity.cast("decimal(20,0)")).withColumn("one", F.lit(1))
            .withColumn("home", home.cast("decimal(20,0)"))
            .withColumn("over", share(F.greatest(F.col("home") - F.col("cap"), F.lit(0)), "n"))
            .withColumn("room", share(F.greatest(F.col("cap") - F.col("home"), F.lit(0)), "one")))
    ring = Window.orderBy("cell")
    flow = flow.withColumn("s", F.sum(F.col("over") - F.col("room")).over(ring))
    start = F.max(F.struct(-F.col("s"), -F.col("cell"))).over(Window.partitionBy())["col2"]
    flow = flow.withColumn("turn", (F.col("cell") + start) <= 0).withColumn("turned", F.struct("turn", "cell"))
    round_ring = Window.orderBy("turned")
    flow = (flow.withColumn("s", F.sum(F.col("over") - F.col("room")).over(round_ring))
            .withColumn("under_way", F.col("s") - F.least(F.lit(0), F.min("s").over(round_ring)))
            .withColumn("used", F.coalesce(F.lag("under_way").over(round_ring), F.lit(0)) + F.col("over") - F.col("under_way"))
            .withColumn("kept", F.col("n") - F.col("over")))
    upto_ring = round_ring.rowsBetween(Window.unboundedPreceding, -1)
    flow = stored(flow.withColumn("surplus_from", F.coalesce(F.sum("over").over(upto_ring), F.lit(0)))
                  .withColumn("place_from", F.coalesce(F.sum("used").over(upto_ring), F.lit(0)))
                  .withColumn("slot_from", F.coalesce(F.sum(F.col("kept") + F.col("used")).over(before), F.lit(0)))
                  .select("cell", "shard", "kept", "over", "used", "surplus_from", "place_from", "slot_from"), "ring")
    # pieces of a cell's keys by rank: those that stay, then one piece for each cell that takes surplus of it
    stay = flow.where("kept > 0").selectExpr("cell AS _cell", "0L AS lo", "kept AS hi", "shard", "slot_from AS slot0")
    gives, takes = flow.where("over > 0"), flow.where("used > 0")
    cuts = (gives.selectExpr("surplus_from AS at").union(takes.selectExpr("place_from AS at")).distinct())
    forward = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    giver = F.struct(*[F.col(c) for c in ("cell", "kept", "surplus_from")])
    taker = F.struct(*[F.col(c) for c in ("shard", "kept", "place_from", "slot_from")])
    runs = (cuts.join(gives.select(F.col("surplus_from").alias("at"), giver.alias("g")), "at", "left")
            .join(takes.select(F.col("place_from").alias("at"), taker.alias("t")), "at", "left")
            .withColumn("g", F.last("g", True).over(forward)).withColumn("t", F.last("t", True).over(forward))
            .withColumn("end", F.coalesce(F.lead("at").over(Window.orderBy("at")), F.lit(2**62))))
    moved = runs.selectExpr("g.cell AS _cell", "g.kept + at - g.surplus_from AS lo", "g.kept + end - g.surplus_from AS hi",
                            "t.shard AS shard", "t.slot_from + t.kept + at - t.place_from AS slot0")
    pieces = stay.union(moved)
    rank = F.row_number().over(Window.partitionBy("_cell").orderBy(*tie)) - 1
    return (placed.withColumn("_rank", rank.cast("long"))
            .join(pieces, (placed["_cell"] == pieces["_cell"]) & F.col("_rank").between(F.col("lo"), F.col("hi") - 1))
            .withColumn("slot", F.col("slot0") + F.col("_rank") - F.col("lo"))
            .drop("_cell", "_rank", "lo", "hi", "slot0"))
