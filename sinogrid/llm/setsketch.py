"""Near-duplicates by SetSketch: mergeable registers, bands, joint likelihood, verification on full sets.

Register i of a set holds a truncated logarithm of the smallest of exponential
values h_i(x) of its elements x: max(0, min(q + 1, floor(1 - log_b min h_i))).
The register of a union is the larger of the two. Two sets have equal registers
the more often the more they share, so sets that agree in a whole band of
registers meet; what meets is judged by the likelihood of its register
comparisons (greater, less, equal, with both set sizes known) and, unless that
or the parity bitmaps of the sets rule the pair out, by the sets themselves.

With 36 bands of 7 registers a pair of Jaccard similarity J meets with a chance
of 1 - (1 - J^7)^36 at least (equal registers are somewhat likelier than J): all
but 9e-7 at 0.85, 6e-11 at 0.9. Equal sets are one node. A bucket never lists
all its pairs: its nodes meet a few pivots, of these pairs each node's likeliest
is verified first, groups are formed of the links, and only pairs of different
groups are verified further. The nodes of buckets that still hold several groups
are listed under their rarest shingles, one of which all pairs above the
similarity share, and nodes outside such a list's largest group meet its others
if both have enough shingles from the listed one on: no copy edited beyond the
limit meets the whole of a large family by the passages that all of it has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinogrid.llm.components import components
from sinogrid.llm.pairing import alike_pairs, child_parent, node_texts, parity_bits, parity_distance, shingle_set, texts_of, with_groups
from sinogrid.llm.tables import NO_ID, discarded, kept, texts

SEED = 11
REGISTERS, BAND = 256, 7
BASE, RATE, TOP = 1.125, 20.0, 255
_CHUNK = 1 << 12
_MIX = np.uint32(0x9E3779B1)
_COUNT_BITS = 20
#: twice the log likelihood ratio from which a similarity is ruled out: 6 standard deviations
RULED_OUT = 36.0


def _keys(count: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(SEED)
    return (r.integers(0, 2**32, count, np.uint32) | np.uint32(1))[:, None], r.integers(0, 2**32, count, np.uint32)[:, None]


def registers(elements: np.ndarray, count: int = REGISTERS) -> np.ndarray:
    """The registers (one byte each) of a set of 64-bit hashes; of no elements all zero."""
    odd, add = _keys(count)
    least = np.full(count, 2**32 - 1, np.uint32)
    for at in range(0, len(elements), _CHUNK):
        some = elements[at:at + _CHUNK]
        x = (some ^ (some >> np.uint64(32))).astype(np.uint32)[None, :] * odd
        x += add
        x ^= x >> np.uint32(15)
        x *= _MIX
        x ^= x >> np.uint32(13)
        np.minimum(least, x.min(axis=1), out=least)
    if not len(elements):
        return np.zeros(count, np.uint8)
    exponential = -np.log1p(-(least + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, TOP).astype(np.uint8)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of a union."""
    return np.maximum(a, b)


def _chance(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)


def _likelihood(j: np.ndarray, u: np.ndarray, v: np.ndarray, above: np.ndarray, below: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Log likelihood of a similarity j: u and v are the sets' shares of their summed sizes."""
    p, q = _chance(u - v * j), _chance(v - u * j)
    return above * np.log(p) + below * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(most likely similarity, twice the log likelihood it has above `similarity`: 0 if it is not below, infinite if the sizes rule that out) of rows of registers.

    The likelihood is concave in the similarity, so that thirds of an interval find its top.
    """
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - above - below
    u = n_a / (n_a + n_b)
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    most = high.copy()
    for _ in range(48):
        x, y = low + (high - low) / 3, high - (high - low) / 3
        rising = _likelihood(x, u, v, above, below, same) < _likelihood(y, u, v, above, below, same)
        low, high = np.where(rising, x, low), np.where(rising, high, y)
    top = (low + high) / 2
    limit = np.minimum(similarity, most)
    lost = 2 * (_likelihood(top, u, v, above, below, same) - _likelihood(limit, u, v, above, below, same))
    return top, np.where(most < similarity - 1e-9, np.inf, np.where(top >= limit, 0.0, lost))


def sketches(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, mark, n, regs, odd) of documents: digest and size of the shingle set, its registers and its parity bitmap."""

    @F.arrow_udf("struct<mark: binary, n: bigint, regs: binary, odd: binary>")
    def of(text: pa.Array) -> pa.Array:
        sets = [shingle_set(t.as_py().encode(), words) for t in text]
        return pa.StructArray.from_arrays([pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                                           pa.array(list(map(len, sets)), pa.int64()), pa.array([registers(s).tobytes() for s in sets], pa.binary()),
                                           pa.array(list(map(parity_bits, sets)), pa.binary())], ["mark", "n", "regs", "odd"])

    return texts(docs).select("doc_id", of("text").alias("s")).select("doc_id", "s.*")


def _buckets(nodes: DataFrame) -> DataFrame:
    """Listings (block, node, many): bands of registers with more than one node, and how many."""
    bands = [F.xxhash64(F.lit(k), F.substring("regs", k * BAND + 1, BAND)) for k in range(REGISTERS // BAND)]
    listed = nodes.where("n > 0").select("node", F.explode(F.array(*bands)).alias("block"))
    sizes = listed.groupBy("block").agg(F.count(F.lit(1)).alias("many")).where("many > 1")
    return listed.join(sizes, "block")


def _pivoted(listed: DataFrame, pivots: int) -> DataFrame:
    """Pairs (child, parent) of the nodes of a block with `pivots` of them, the first ones by several hashes."""
    chosen = [F.min(F.struct(F.xxhash64("node", *[F.lit(k)] * (k > 0)), "node"))["node"] for k in range(pivots)]
    pivot = listed.groupBy("block").agg(F.array_distinct(F.array(*chosen)).alias("p"))
    pairs = listed.join(pivot, "block").select("node", F.explode("p").alias("other")).where("node <> other")
    return pairs.select(*child_parent("node", "other")).distinct()


def _plausible(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(child, parent, estimate) of pairs that neither set sizes, parity bitmaps nor the likelihood of their registers rule out.

    Sets of a Jaccard similarity s have (n_a + n_b) (1 - s) / (1 + s) elements at
    most that are not in both, and parity bitmaps cannot differ in more places.
    """
    share = Fraction(str(similarity))

    @F.arrow_udf("struct<estimate: double, lost: double>")
    def judged(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array, odd_a: pa.Array, odd_b: pa.Array) -> pa.Array:
        n_a, n_b = (x.to_numpy().astype(float) for x in (n_a, n_b))
        apart = np.array([parity_distance(x, y) for x, y in zip(odd_a.to_pylist(), odd_b.to_pylist())], np.int64)
        able = pa.array(apart * (share.denominator + share.numerator) <= (n_a + n_b) * (share.denominator - share.numerator))
        rows = [np.frombuffer(b"".join(x.filter(able).to_pylist()), np.uint8).reshape(-1, REGISTERS) for x in (a, b)]
        able = able.to_numpy(zero_copy_only=False)
        out = [np.zeros(len(able)), np.full(len(able), np.inf)]
        for whole, part in zip(out, estimated(*rows, n_a[able], n_b[able], similarity)):
            whole[able] = part
        return pa.StructArray.from_arrays([pa.array(x, pa.float64()) for x in out], ["estimate", "lost"])

    for x in ("child", "parent"):
        pairs = pairs.join(nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("regs", "n", "odd")]), x)
    near = F.least("n_child", "n_parent") * share.denominator >= F.greatest("n_child", "n_parent") * share.numerator
    told = pairs.where(near).select("child", "parent", judged("regs_child", "regs_parent", "n_child", "n_parent", "odd_child", "odd_parent").alias("j"))
    return told.where(F.col("j.lost") < RULED_OUT).select("child", "parent", F.col("j.estimate").alias("estimate"))


def _rare(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """(node, n, after, shingle): the n - ceil(s n) + 1 rarest shingles of each document of n; two sets of similarity s share one of theirs.

    `after` is how many of its shingles are no rarer, itself included.

    Rarity is counted in 2^20 hash buckets over these documents: any order is
    right, this one keeps common passages apart. What is counted once is shared
    with none and left out.
    """
    share, low = Fraction(str(similarity)), np.uint64(64 - _COUNT_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << _COUNT_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                np.add.at(seen, (shingle_set(text.as_py().encode(), words) >> low).astype(np.int64), 1)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(seen[at])], names=["at", "n"])

    seen = np.zeros(1 << _COUNT_BITS, np.int64)
    told = docs.select("text").mapInArrow(count, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).where("n > 1").toArrow()
    seen[told["at"].to_numpy()] = told["n"].to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(seen)

    @F.arrow_udf("struct<n: int, alone: int, shingles: array<bigint>>")
    def first(text: pa.Array) -> pa.Array:
        sizes, alone, out = [], [], []
        for t in text:
            own = shingle_set(t.as_py().encode(), words)
            often = shared.value[(own >> low).astype(np.int64)]
            order = np.argsort(often, kind="stable")[:len(own) - -(-share.numerator * len(own) // share.denominator) + 1]
            met = order[often[order] > 0]
            sizes.append(len(own))
            alone.append(len(order) - len(met))
            out.append(own[met].view(np.int64))
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int32()), pa.array(alone, pa.int32()), pa.array(out, pa.list_(pa.int64()))], ["n", "alone", "shingles"])

    rows = docs.select("node", first("text").alias("r")).select("node", "r.n", "r.alone", F.posexplode("r.shingles").alias("at", "shingle"))
    return rows.select("node", "n", (F.col("n") - F.col("alone") - F.col("at")).alias("after"), "shingle")


def _across(listed: DataFrame, found: DataFrame, key: str, similarity: float) -> DataFrame:
    """Pairs (child, parent) of one block and different groups, one of them outside the block's largest group.

    Of sets listed by `_rare` a pair meets where each has, from the shingle on,
    as many as two sets of their sizes and the similarity have in common: so has
    the first shingle that both have.
    """
    share = Fraction(str(similarity))
    sided = kept(with_groups(listed, found, ("node",)), "sided")
    sums = sided.groupBy(key, "c_node").agg(F.count(F.lit(1)).alias("k"))
    largest = sums.groupBy(key).agg(F.max_by("c_node", F.struct("k", "c_node")).alias("largest"), F.count(F.lit(1)).alias("groups"))
    still = sided.join(largest.where("groups > 1").drop("groups"), key)
    a = still.where("c_node <> largest").select(key, *[F.col(c).alias(f"{c}_x") for c in ("node", "c_node", "n", "after")])
    b = still.select(key, (F.col("c_node") == F.col("largest")).alias("main"), *[F.col(c).alias(f"{c}_y") for c in ("node", "c_node", "n", "after")])
    enough = F.least("after_x", "after_y") * (share.denominator + share.numerator) >= (F.col("n_x") + F.col("n_y")) * share.numerator
    once = F.col("main") | (F.col("node_x") < F.col("node_y"))
    return a.join(b, key).where((F.col("c_node_x") != F.col("c_node_y")) & once & enough).select(*child_parent("node_x", "node_y")).distinct()


def _open_nodes(listed: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes of blocks that have nodes of different groups."""
    sided = with_groups(listed, found, ("node",))
    mixed = sided.groupBy("block").agg((F.min("c_node") < F.max("c_node")).alias("mixed")).where("mixed").select("block")
    return kept(listed.join(mixed, "block", "left_semi").select("node").distinct(), "ids")


def links(nodes: DataFrame, docs: DataFrame, words: int, similarity: float, pivots: int = 3) -> DataFrame:
    """Edges (a, b) between nodes whose groups are those of all similar pairs that share a band of registers.

    `nodes` are (node, n, regs, odd), `docs` (node, text) of the same nodes at least.
    """
    listed = kept(_buckets(nodes), "buckets")
    likely = kept(_plausible(_pivoted(listed, pivots), nodes, similarity), "likely")
    best = likely.groupBy("child").agg(F.max_by("parent", F.struct("estimate", "parent")).alias("parent"))
    found = alike_pairs(kept(best, "pairs"), docs, words, similarity)
    other = with_groups(likely, found, ("child", "parent")).where("c_child <> c_parent").select("child", "parent")
    found = found.union(alike_pairs(kept(other, "pairs"), docs, words, similarity))

    ids = _open_nodes(listed, found)
    discarded(listed)
    rare = kept(_rare(texts_of(docs, ids).join(ids, "node", "left_semi"), words, similarity), "rare")
    pairs = _across(rare, found, "shingle", similarity).join(likely, ["child", "parent"], "left_anti")
    able = kept(_plausible(pairs, nodes, similarity).select("child", "parent"), "pairs")
    discarded(rare)
    return found.union(alike_pairs(able, docs, words, similarity))


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.85, **settings) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document: groups of documents whose shingle sets are similar.

    A null text is empty. Texts without words have no shingles and are linked
    with nothing. Rows of one doc_id are one document of several texts to the
    links. A null doc_id counts as smaller than any other; the component_id of a
    group that holds one is null. Repeated rows come out as often as they come
    in. No documents give no rows; further columns are left out.
    """
    rows = kept(sketches(docs, words), "sketches")
    own = F.coalesce("doc_id", F.lit(NO_ID))
    nodes = kept(rows.where("n > 0").groupBy("mark").agg(F.min(own).alias("node"), *[F.first(c).alias(c) for c in ("n", "regs", "odd")]), "nodes")
    whole = node_texts(docs, rows)
    group = components(links(nodes, whole, words, similarity, **settings))
    named = nodes.join(group, "node", "left").select("mark", F.coalesce("component", "node").alias("component"))
    out = rows.join(named, "mark", "left").select("doc_id", "n", F.coalesce("component", own).alias("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.nullif("component", F.lit(NO_ID)).alias("component_id"), (F.col("component") == own).alias("kept"))
