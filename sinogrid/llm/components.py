"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinogrid.llm.tables import kept


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that can be reached, for nodes with an edge.

    Alternating large-star and small-star steps: every node passes the smallest
    node it knows first to its larger, then to its smaller neighbours. What a
    node knows is a minimum, aggregated before the shuffle, never a list. Each
    step is written to the shared folder. No edges give no rows; loops and
    repeated edges change nothing.
    """
    tie = F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("tie")
    current = kept(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = current.agg(F.count("*"), tie).first()
    while True:
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = kept(large, "edges")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", "m")).where("a <> b").distinct())
        current = kept(small, "edges")
        now = current.agg(F.count("*"), tie).first()
        if now == seen:
            break
        seen = now
    return current.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
