"""Steps that similarity joins share: parity bitmaps, order of a pair, texts of chosen ids, comparison of full sets, groups of links."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinogrid.llm.components import components
from sinogrid.llm.tables import NO_ID, kept, texts

SEED = 11
_ID_BITS = 26


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The different 64-bit hashes of a text's word shingles, sorted; fewer words are one shingle, none are none."""
    found = text.lower().split()  # of bytes: A-Z alone, and white space is \\x20 and \\x09-\\x0D
    if not found:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh3_64_intdigest
    after = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    ends = ((after[words - 1:] if len(found) > words else after[-1:]) - 1).tolist()
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip([0, *after.tolist()], ends)], dtype=np.uint64))


def parity_bits(hashes: np.ndarray) -> bytes:
    """Of each of 2^k places (64 at least, as many as hashes up to 2^16) whether an odd number of hashes fall on it.

    Two sets differ in as many places at most as they have elements of their
    own. Folding the halves of a wide bitmap on one another gives the narrow one.
    """
    places = 1 << min(max(int(len(hashes) - 1).bit_length(), 6), 16)
    odd = np.bincount((hashes & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """Places in which two parity bitmaps differ, the wider one folded to the width of the other."""
    one, other = sorted((np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)), key=len)
    while len(other) > len(one):
        other = other[:len(other) // 2] ^ other[len(other) // 2:]
    return int(np.bitwise_count(one ^ other).sum())


def child_parent(one: str, other: str) -> list:
    """Two nodes as (child, parent) by a hash order of all nodes."""
    first = F.struct(F.xxhash64(one), one) > F.struct(F.xxhash64(other), other)
    return [F.when(first, F.col(one)).otherwise(F.col(other)).alias("child"), F.when(first, F.col(other)).otherwise(F.col(one)).alias("parent")]


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents (node, text) with one of the ids, and few others: a bitmap of fixed size goes to the scan."""
    place = F.shiftrightunsigned(F.xxhash64("node"), 64 - _ID_BITS)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    told = ids.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    packed = np.zeros(2**_ID_BITS // 64, np.int64)
    packed[told["word"].to_numpy()] = told["bits"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    @F.arrow_udf("boolean")
    def listed(place: pa.Array) -> pa.Array:
        at = place.to_numpy()
        return pa.array(shared.value[at >> 6] >> (at & 63) & 1 == 1)

    return docs.where(listed(place))


def alike_pairs(pairs: DataFrame, docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (a, b): pairs (child, parent) of documents whose full sets are similar. Texts go to their pairs and are cut there.

    The joins shuffle, however few the pairs: over a broadcast one the scan's
    Python and that of the comparison are one stage, where each task has two
    workers, which an executor keeps from then on.
    """
    share = Fraction(str(similarity))

    @F.arrow_udf("boolean")
    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out, last, own = [], None, None
        for x, y in zip(a, b):
            y = y.as_py()
            if y != last:
                last, own = y, shingle_set(y.encode(), words)
            one = shingle_set(x.as_py().encode(), words)
            both = len(np.intersect1d(one, own, assume_unique=True))
            out.append(both * share.denominator >= (len(one) + len(own) - both) * share.numerator)
        return pa.array(out, pa.bool_())

    held = texts_of(docs, pairs.select(F.col("child").alias("node")).union(pairs.select("parent")).distinct())
    for x in ("child", "parent"):
        pairs = pairs.join(held.select(F.col("node").alias(x), F.col("text").alias(f"t_{x}")).hint("merge"), x)
    return kept(pairs.where(alike("t_child", "t_parent")).select(F.col("child").alias("a"), F.col("parent").alias("b")), "links")


def with_groups(listed: DataFrame, found: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """`listed` with the groups of the nodes in each of the columns, named c_ and the column."""
    group = kept(components(found), "groups")
    for x in names:
        listed = listed.join(group.toDF(x, f"c_{x}"), x, "left").withColumn(f"c_{x}", F.coalesce(f"c_{x}", x))
    return listed


def node_texts(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, text): the texts of documents by their ids; of an id that repeats in `rows` one row for each different text."""
    own = F.coalesce("doc_id", F.lit(NO_ID))
    whole = texts(docs).select(own.alias("node"), "text")
    again = kept(rows.groupBy(own.alias("node")).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("node"), "again")
    if again.isEmpty():
        return whole
    repeated = texts_of(whole, again).join(again, "node", "left_semi").groupBy("node", F.xxhash64("text")).agg(F.first("text").alias("text")).select("node", "text")
    return whole.join(again, "node", "left_anti").union(repeated)
