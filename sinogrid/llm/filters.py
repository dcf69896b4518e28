"""How ordered document filters act on one another, by relations of failing ids.

Each filter has a table of the ids that fail it, written once. All tables lie by
id, so the joins below need no further exchange of rows:

- survivors of a set of filters: ids with any failure, left-anti joined with the
  table of each filter of the set, plus the ids that no table holds;
- what a filter removes behind a set: its own table, left-anti joined with the
  tables of the set; behind all the others these are its unique failures;
- what is redundant behind a set: its table, left-semi joined with the set's.

What a step of an order does depends on the set before it alone, so 32 sets and
80 (set, filter) pairs stand for all 120 orders of five filters. An id is listed
once for each of its sets, behind the exchange; the conditions of the joins name
the sets that a table counts for. Sums are made where the rows are.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinogrid.llm.tables import NO_ID, kept

#: white space between words: a class for patterns, and as characters
SPACE, SPACES = "[\\x20\\x09-\\x0D]+", " \t\n\x0b\f\r"
KEY = ["id", "h"]


def own_failures(text: Column) -> dict[str, Callable[[], Column]]:
    """Filters A to D as conditions on a column `words` (array; one empty word if there are none) and the text."""
    words, code_points = F.when(F.col("words")[0] == "", 0).otherwise(F.size("words")), F.length(text)
    return {
        "A": words < 200,
        "B": 100 * F.size(F.array_distinct("words")) < 50 * words,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * code_points,
        "D": text.rlike("[#$%&*|]"),
    }


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, h, part, n, good, toxic, digest, A..D): distinct documents with their labels; n counts repeated rows.

    `h` tells texts of a repeated doc_id apart. A null id is a value of its own,
    smaller than any other, and has no label; a null text is empty; a null lang
    is the part ''. An id has a label if any of its rows in `labels` says so.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       text.alias("text"))
    rows = rows.select("id", "part", "text", F.split(F.btrim("text", F.lit(SPACES)), SPACE).alias("words"))
    flags = [c.alias(name) for name, c in own_failures(F.col("text")).items()]
    rows = rows.select("id", F.xxhash64("text").alias("h"), "part", F.unhex(F.sha2("text", 256)).alias("digest"), *flags)
    rows = rows.groupBy(*KEY, "part", "digest", *"ABCD").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    return rows.join(marks, "id", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})


def failing_ids(rows: DataFrame, names: str = "ABCD") -> dict[str, DataFrame]:
    """One stored table (id, h, part, n, good, toxic) per filter; E holds the copies of a smaller id's text."""
    held = [*KEY, "part", "n", "good", "toxic"]
    found = {name: rows.where(name).select(*held) for name in names}
    first = rows.groupBy("digest").agg(F.min("id").alias("id"))
    found["E"] = rows.join(first, ["id", "digest"], "left_anti").select(*held)
    return {name: kept(df, f"failing-{name}") for name, df in found.items()}


def _sums(*names: str) -> list[Column]:
    return [F.sum(F.col("n") * c).cast("long").alias(name) for c, name in zip((F.lit(1), F.col("good"), F.col("toxic")), names or ("n", "good", "toxic"))]


def _behind(listed: DataFrame, failing: dict[str, DataFrame]) -> DataFrame:
    """Rows (id, h, before) that fail no filter of the set `before`, a bit per filter."""
    for k, df in enumerate(failing.values()):
        theirs = df.select(F.col("id").alias("f_id"), F.col("h").alias("f_h")).distinct()
        counts = F.col("before").bitwiseAND(F.lit(1 << k)) != 0
        listed = listed.join(theirs, (F.col("id") == F.col("f_id")) & (F.col("h") == F.col("f_h")) & counts, "left_anti")
    return listed


def interactions(rows: DataFrame, failing: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """What survives each set of filters: (part, before, n, good, toxic), and what each filter does behind each set of others:
    (part, filter, before, removed, good_lost, toxic_lost, redundant). Rows that would be zero may be missing."""
    count = len(failing)
    sets = F.array(*[F.lit(s) for s in range(1 << count)])
    table = None
    for k, df in enumerate(failing.values()):
        one = df.withColumn("filter", F.lit(k))
        table = one if table is None else table.unionByName(one)
    clean = rows
    for df in failing.values():
        clean = clean.join(df.select(*KEY).distinct(), KEY, "left_anti")
    clean = clean.groupBy("part").agg(*_sums())

    some = table.drop("filter").distinct().withColumn("before", F.explode(sets))
    alive = _behind(some, failing).groupBy("part", "before").agg(*_sums())
    alive = alive.unionByName(clean.withColumn("before", F.explode(sets))).groupBy("part", "before").agg(
        *[F.sum(c).alias(c) for c in ("n", "good", "toxic")])

    own = table.withColumn("before", F.explode(sets)).where(F.expr("(before & shiftleft(1, filter)) = 0"))
    removed = _behind(own, failing).groupBy("part", "filter", "before").agg(*_sums("removed", "good_lost", "toxic_lost"))
    earlier = table.select(F.col("id").alias("f_id"), F.col("h").alias("f_h"), F.col("filter").alias("by")).distinct()
    again = own.join(earlier, (F.col("id") == F.col("f_id")) & (F.col("h") == F.col("f_h")) & F.expr("(before & shiftleft(1, by)) <> 0"), "left_semi")
    redundant = again.groupBy("part", "filter", "before").agg(F.sum("n").alias("redundant"))
    return alive, removed.join(redundant, ["part", "filter", "before"], "full")


def orders(count: int) -> list[tuple]:
    """(order, step, filter, before) for all steps of all orders of the filters 0 to count - 1."""
    names = "ABCDEFGHIJ"[:count]
    return [("".join(names[k] for k in order), step + 1, order[step], sum(1 << k for k in order[:step]))
            for order in permutations(range(count)) for step in range(count)]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step; see the module's text.

    Repeated rows count as often as they come. Further columns are left out. No
    documents give no rows.
    """
    rows = kept(judged(docs, labels), "judged")
    failing = failing_ids(rows)
    alive, acts = interactions(rows, failing)
    alive, acts = kept(alive, "alive"), kept(acts, "acts")
    count = len(failing)
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(f).alias("filter"), F.lit(b).alias("before"))
                      for o, s, f, b in orders(count)])
    lines = alive.select("part").distinct().select("part", F.explode(steps).alias("s")).select("part", "s.*")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    size = F.element_at(F.array(*[F.lit(factorial(k) * factorial(count - 1 - k)) for k in range(count)]), F.bit_count("before") + 1)
    whole = acts.groupBy("part", "filter").agg(
        zero(F.when(F.bit_count("before") == count - 1, F.col("removed"))).alias("unique_fails"), zero(F.col("removed") * size).alias("shapley"))
    after = alive.select("part", F.col("before").alias("after"), F.col("n").alias("kept"))
    out = (lines.withColumn("after", F.expr("before | shiftleft(1, filter)"))
           .join(after, ["part", "after"], "left").join(acts, ["part", "filter", "before"], "left").join(whole, ["part", "filter"], "left"))
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return out.select("part", "filter_order", "step", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts])
