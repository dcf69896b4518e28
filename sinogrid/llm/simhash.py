"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming verification, groups.

A fingerprint bit is 1 if it is set in over half the hashes of the word
shingles. Fingerprints are split into parts; two of them at a distance of at
most parts - agree have `agree` equal parts, so that they meet in the block of
those parts and are compared there. Equal fingerprints are one node, however
many documents have it.

A block of up to `small` nodes compares all its pairs. Larger blocks, which a
big family of near copies makes, never do:

- up to distance 2, each of their nodes is listed under itself and its 64 one-bit
  neighbours. Two fingerprints have a listing in common exactly if they differ in
  2 bits at most, so each listing links its nodes to its smallest one.
- beyond, each node is first compared with one pivot of the block. Once
  groups are formed of that, every node outside the block's largest group is
  compared with all nodes of the block, and groups are formed anew. Pairs within
  one group need no link of their own.

Wide fingerprints estimate a Jaccard similarity, and lose pairs near the limit.
In `alike` they propose, the similarity itself decides, and pairs that share no
block of bits meet under their rarest shingles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sinogrid.llm.components import components
from sinogrid.llm.pairing import alike_pairs, child_parent, node_texts, parity_bits, parity_distance, with_groups
from sinogrid.llm.tables import NO_ID, discarded, kept, texts, unused

SEED = 42
_LOW_BITS = np.uint64(0x0101010101010101)
_AT_ONCE = 255 * 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)
_COUNT_BITS = 20


def shingle_hashes(text: bytes, words: int):
    """XXH64 of the space-joined word shingles, in blocks; fewer words make one shingle, none make none."""
    found = text.lower().split()  # of bytes: A-Z alone, and white space is \\x20 and \\x09-\\x0D
    if not found:
        return
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    after = np.fromiter(map(len, found), dtype=np.int64, count=len(found))
    after = np.cumsum(after + 1)
    ends = (after[words - 1:] if len(found) > words else after[-1:]) - 1
    ends, starts = ends.tolist(), [0, *after.tolist()]
    for at in range(0, len(ends), _AT_ONCE):
        spans = zip(starts[at:at + _AT_ONCE], ends[at:at + _AT_ONCE])
        yield np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)


def bit_counts(hashes: np.ndarray) -> np.ndarray:
    """For each row of hashes how many of them have each of the 64 bits set: byte lanes of one word, 255 hashes at a time."""
    rows, n = hashes.shape
    deep = min(255, n)
    full = np.zeros((rows, deep * -(-n // deep)), dtype=np.uint64)
    full[:, :n] = hashes
    full = full.reshape(rows, -1, deep)
    lane = np.empty_like(full)
    out = np.empty((rows, 8, 8), dtype=np.int64)
    for k in range(8):
        np.right_shift(full, np.uint64(k), out=lane)
        np.bitwise_and(lane, _LOW_BITS, out=lane)
        sums = np.add.reduce(lane, axis=2)
        out[:, :, k] = sums.view(np.uint8).reshape(rows, -1, 8).sum(axis=1, dtype=np.int64)
    return out.reshape(rows, 64)


def remixed(hashes: np.ndarray, rows: int) -> np.ndarray:
    """`rows` words of 64 bits for each hash; the first is the hash itself."""
    if rows == 1:
        return hashes[None, :]
    x = (hashes[None, :] + (np.arange(rows, dtype=np.uint64) * _ODD)[:, None]) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= _ODD
    x[0] = hashes
    return x


def fingerprint_words(text: bytes, words: int, bits: int) -> list[int]:
    """The fingerprint as signed 64-bit words; no words in the text: all zero."""
    counts, n = np.zeros((bits // 64, 64), dtype=np.int64), 0
    for hashes in shingle_hashes(text, words):
        n += len(hashes)
        for at in range(0, len(hashes), _AT_ONCE // (bits // 64)):
            counts += bit_counts(remixed(hashes[at:at + _AT_ONCE // (bits // 64)], bits // 64))
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view(np.int64).reshape(-1).tolist()


def fingerprints(docs: DataFrame, words: int = 3, bits: int = 64) -> DataFrame:
    """(doc_id, fp) of documents: fp is an array of bits / 64 words."""

    @F.arrow_udf("array<bigint>")
    def of(text: pa.Array) -> pa.Array:
        return pa.array([fingerprint_words(t, words, bits) for t in text.cast(pa.binary()).to_pylist()], pa.list_(pa.int64()))

    return texts(docs).select("doc_id", of("text").alias("fp"))


def _part(number: int, width: int) -> Column:
    """Bits of the fingerprint from number * width on, as a long."""
    word, at = divmod(number * width, 64)
    low = F.shiftrightunsigned(F.col("fp")[word], at)
    if at + width > 64:
        low = low.bitwiseOR(F.shiftleft(F.col("fp")[word + 1], 64 - at))
    return low.bitwiseAND(F.lit(2**width - 1))


def _distance(bits: int) -> Column:
    return sum((F.bit_count(F.col("fp_a")[k].bitwiseXOR(F.col("fp_b")[k])) for k in range(bits // 64)), F.lit(0))


def _verified(pairs: DataFrame, nodes: DataFrame, bits: int, distance: int) -> DataFrame:
    a, b = (nodes.select(F.col("node").alias(n), F.col("fp").alias(f"fp_{n}")) for n in "ab")
    return pairs.distinct().join(a, "a").join(b, "b").where(_distance(bits) <= distance).select("a", "b")


def _linked(listed: DataFrame, verified: Callable[[DataFrame], DataFrame], small: int) -> DataFrame:
    """Edges (a, b) whose groups are those of all `verified` pairs of nodes listed (node, block) in one block."""
    members = _shared(listed)
    pairs, many = _pairs(members, small), members.where(F.col("n") > small)
    pivot = many.groupBy("block").agg(F.min_by("node", F.xxhash64("node")).alias("b"))
    compared = pairs.union(many.select("block", F.col("node").alias("a")).join(pivot, "block").where("a <> b").select("a", "b"))
    found = kept(verified(compared), "links")
    # in large blocks: whatever is not in the block's largest group meets all the others
    group = components(found)
    sided = kept(many.select("block", "node").join(group, "node", "left").withColumn("component", F.coalesce("component", "node")), "blocks")
    sums = sided.groupBy("block", "component").agg(F.count("*").alias("n"))
    largest = sums.groupBy("block").agg(F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("groups")).where("groups > 1")
    open_blocks = sided.join(largest, "block")
    rest = (open_blocks.where("component <> largest").select("block", F.col("node").alias("a"), F.col("component").alias("ca"))
            .join(open_blocks.select("block", F.col("node").alias("b"), F.col("component").alias("cb")), "block")
            .where("ca <> cb").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    return found.union(verified(rest))


def _shared(listed: DataFrame) -> DataFrame:
    """Listings (block, node, n, least) of blocks of more than one node, stored."""
    sizes = listed.groupBy("block").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1")
    return kept(listed.join(sizes, "block"), "blocks")


def _pairs(members: DataFrame, small: int) -> DataFrame:
    few = members.where(F.col("n") <= small).select("block", "node")
    return few.toDF("block", "a").join(few.toDF("block", "b"), "block").where("a < b").select("a", "b")


def links(nodes: DataFrame, bits: int, parts: int, agree: int, distance: int, small: int = 24) -> DataFrame:
    """Edges (a, b) between nodes (node, fp) whose groups are those of all pairs within `distance` that share a block."""
    width = bits // parts
    keys = [F.xxhash64(F.lit(n), *[_part(p, width) for p in chosen]) for n, chosen in enumerate(combinations(range(parts), agree))]
    listed = nodes.select("node", F.explode(F.array(*keys)).alias("block"))
    if distance > 2:
        return _linked(listed, lambda pairs: _verified(pairs, nodes, bits, distance), small)
    members = _shared(listed)
    large = members.where(F.col("n") > small).select("node").distinct().join(nodes, "node")
    flips = [F.col("fp")[0]] + [F.col("fp")[0].bitwiseXOR(F.lit(2**k if k < 63 else -(2**63))) for k in range(64)]
    under = large.select("node", F.explode(F.array(*flips)).alias("z"))
    star = under.join(under.groupBy("z").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n"), "z")
    return _verified(_pairs(members, small), nodes, bits, distance).union(star.select(F.col("node").alias("a"), "b").where("a <> b").distinct())


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """The different shingle hashes of a text, sorted."""
    found = list(shingle_hashes(text, words))
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _common(docs: DataFrame, words: int) -> np.ndarray:
    """How many documents have a shingle of each hash bucket, for buckets that stand out in a task; 0 for the others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(2**_COUNT_BITS, np.int64)
        for batch in batches:
            for text in batch.column(0):
                seen[(shingle_set(text.as_py().encode(), words) >> np.uint64(64 - _COUNT_BITS)).astype(np.int64)] += 1
        mean = seen.mean()
        out = np.nonzero(seen > 3 + mean + 6 * mean**0.5)[0]
        yield pa.RecordBatch.from_arrays([pa.array(out.astype(np.int32)), pa.array(seen[out])], names=["bucket", "n"])

    total = np.zeros(2**_COUNT_BITS, np.int64)
    for r in texts(docs).select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[r["bucket"]] = r["n"]
    return total


def _described(docs: DataFrame, words: int, share: Fraction, bits: int) -> DataFrame:
    """(doc_id, mark, n, fp, odd, prefix): of each shingle set a digest, its size, SimHash, parity bitmap and first shingles, rare ones first.

    Two sets with a Jaccard similarity of at least `share` have a shingle in
    common among the first n - ceil(share * n) + 1 of each, in any order that is
    the same for all; this one keeps common passages out of the blocks.
    """
    total = _common(docs, words)
    few = np.nonzero(total)[0]
    shared = docs.sparkSession.sparkContext.broadcast((few, total[few]))
    kinds = {"mark": pa.binary(), "n": pa.int32(), "fp": pa.list_(pa.int64()), "odd": pa.binary(), "prefix": pa.list_(pa.int64())}

    @F.arrow_udf("struct<mark: binary, n: int, fp: array<bigint>, odd: binary, prefix: array<bigint>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        count = np.zeros(2**_COUNT_BITS, np.int64)
        count[shared.value[0]] = shared.value[1]
        for batch in batches:
            rows = []
            for text in batch:
                found = shingle_set(text.as_py().encode(), words)
                n = len(found)
                order = np.argsort(count[(found >> np.uint64(64 - _COUNT_BITS)).astype(np.int64)], kind="stable")
                prefix = found[order[:n - -(-share.numerator * n // share.denominator) + 1]].view(np.int64)
                rows.append((hashlib.blake2b(found.tobytes(), digest_size=16).digest(), n, _set_fingerprint(found, bits), parity_bits(found), prefix))
            columns = zip(*rows) if rows else [[]] * len(kinds)
            yield pa.StructArray.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, kinds.values())], list(kinds))

    return texts(docs).select("doc_id", of("text").alias("s")).select("doc_id", "s.*")


def _set_fingerprint(hashes: np.ndarray, bits: int) -> np.ndarray:
    """SimHash of a set of shingle hashes."""
    counts, step = np.zeros((bits // 64, 64), dtype=np.int64), _AT_ONCE // (bits // 64)
    for at in range(0, len(hashes), step):
        counts += bit_counts(remixed(hashes[at:at + step], bits // 64))
    return np.packbits(2 * counts > len(hashes), axis=1, bitorder="little").view(np.int64).reshape(-1)


def _plausible(pairs: DataFrame, nodes: DataFrame, share: Fraction, bits: int, distance: int | None) -> DataFrame:
    """(child, parent, apart): pairs within the Hamming distance, if one is given, that neither sizes nor parity bitmaps rule out.

    Sets of a Jaccard similarity s have (n_a + n_b) (1 - s) / (1 + s) elements at
    most that are not in both, and parity bitmaps cannot differ in more places.
    """

    @F.arrow_udf("int")
    def differing(a: pa.Array, b: pa.Array) -> pa.Array:
        return pa.array([parity_distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())

    wanted = ["n", "odd"] + ["fp"] * (distance is not None)
    for x, own in (("child", "a"), ("parent", "b")):
        pairs = pairs.join(nodes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{own}") for c in wanted]), x)
    pairs = pairs.where(F.least("n_a", "n_b") * share.denominator >= F.greatest("n_a", "n_b") * share.numerator)
    if distance is not None:
        pairs = pairs.where(_distance(bits) <= distance)
    told = pairs.select("child", "parent", (F.col("n_a") + F.col("n_b")).alias("sum"), differing("odd_a", "odd_b").alias("d"))
    # chosen within the sum: a filter on d would go below it and run `differing` twice, each in a worker of its own
    able = F.col("d") * (share.denominator + share.numerator) <= F.col("sum") * (share.denominator - share.numerator)
    return told.groupBy("child", "parent").agg(F.min(F.when(able, F.col("d") / F.col("sum"))).alias("apart")).where("apart IS NOT NULL")


def _confirmed(likely: DataFrame, docs: DataFrame, words: int, similarity: float, found: DataFrame | None = None) -> DataFrame:
    """Links among likely pairs, by full sets, after those `found`: each child's nearest parent first, then pairs of groups still apart."""
    nearest = kept(likely.groupBy("child").agg(F.min_by("parent", F.struct("apart", "parent")).alias("parent")), "pairs")
    first = alike_pairs(nearest, docs, words, similarity)
    found = first if found is None else found.union(first)
    other = with_groups(likely, found, ("child", "parent")).where("c_child <> c_parent").select("child", "parent")
    other = kept(other.join(nearest, ["child", "parent"], "left_anti"), "pairs")
    return found.union(alike_pairs(other, docs, words, similarity))


def _block_pairs(nodes: DataFrame, bits: int, parts: int) -> DataFrame:
    """(child, parent): nodes that share a block of fingerprint bits, each with the block's first node by a hash order."""
    keys = [F.xxhash64(F.lit(p), _part(p, bits // parts)) for p in range(parts)]
    listed = nodes.where("n > 0").select("node", F.explode(F.array(*keys)).alias("block"))
    pivot = listed.groupBy("block").agg(F.min_by("node", F.struct(F.xxhash64("node"), "node")).alias("pivot"), F.count("*").alias("many")).where("many > 1")
    return kept(listed.join(pivot, "block").where("node <> pivot").select(*child_parent("node", "pivot")).distinct(), "pairs")


def _prefix_pairs(nodes: DataFrame, found: DataFrame, share: Fraction) -> DataFrame:
    """(child, parent): nodes of different groups that share a prefix shingle, one of them outside the largest group there.

    Both have, from the shingle on, as many as two sets of their sizes and the
    similarity have in common: so has the first shingle that a similar pair shares.
    """
    listed = with_groups(nodes.where("n > 0").select("node", "n", "prefix"), found, ("node",)).select("node", "n", F.col("c_node").alias("c"), F.posexplode("prefix").alias("at", "block"))
    mixed = listed.groupBy("block").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("block")
    listed = kept(listed.join(mixed, "block", "left_semi").select("block", "node", "n", "c", (F.col("n") - F.col("at")).alias("after")), "blocks")
    sums = listed.groupBy("block", "c").agg(F.count("*").alias("k")).groupBy("block").agg(F.max_by("c", F.struct("k", "c")).alias("largest"))
    sided = listed.join(sums, "block")
    a = sided.where("c <> largest").select("block", *[F.col(c).alias(f"{c}_x") for c in ("node", "c", "n", "after")])
    b = sided.select("block", (F.col("c") == F.col("largest")).alias("main"), *[F.col(c).alias(f"{c}_y") for c in ("node", "c", "n", "after")])
    enough = F.least("after_x", "after_y") * (share.denominator + share.numerator) >= (F.col("n_x") + F.col("n_y")) * share.numerator
    once = F.col("main") | (F.col("node_x") < F.col("node_y"))
    pairs = kept(a.join(b, "block").where((F.col("c_x") != F.col("c_y")) & once & enough).select(*child_parent("node_x", "node_y")).distinct(), "pairs")
    discarded(listed)
    return pairs


def alike(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 2304, parts: int = 96, distance: int = 420) -> DataFrame:
    """(doc_id, component_id): groups of all pairs whose shingle sets have a Jaccard similarity of `similarity` or more.

    Blocks of fingerprint bits propose pairs, those within the Hamming distance
    (by default 4 standard deviations above the mean one at 0.8) go on; what
    shares no block meets under a first shingle, so that no pair is lost. Sizes
    and parity bitmaps rule pairs out without error, full sets decide. Texts move
    only with pairs that are left. Null, empty and white texts, null ids and
    repeated rows are treated as by `near_duplicates`.
    """
    share = Fraction(str(similarity))
    rows = kept(_described(docs, words, share, bits), "described")
    own = F.coalesce("doc_id", F.lit(NO_ID))
    nodes = kept(rows.groupBy("mark").agg(F.min(own).alias("node"), *[F.first(c).alias(c) for c in ("n", "fp", "odd", "prefix")]), "nodes")
    whole = node_texts(docs, rows)

    likely = kept(_plausible(_block_pairs(nodes, bits, parts), nodes, share, bits, distance), "likely")
    found = _confirmed(likely, whole, words, similarity)
    rest = _prefix_pairs(nodes, found, share).join(likely, ["child", "parent"], "left_anti")
    found = _confirmed(kept(_plausible(rest, nodes, share, bits, None), "likely"), whole, words, similarity, found)

    named = nodes.join(components(found), "node", "left").select("mark", F.coalesce("component", "node").alias("component_id"))
    out = kept(rows.join(named, "mark").select("doc_id", F.nullif("component_id", F.lit(NO_ID)).alias("component_id")), "groups")
    discarded(rows)
    discarded(nodes)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, bits: int = 2304, parts: int = 96, agree: int = 1, distance: int = 349) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id of each document's group.

    By default the distance is the mean one of shingle sets with a Jaccard
    similarity of 0.8 (cosine 2J / (1 + J), 349 of 2304 bits): about half of the
    pairs at 0.8 are linked, most above 0.83. Distances below `parts` are sure to
    share a block. `alike` links all pairs of a similarity.

    Null and empty texts, and those of white space, have the fingerprint zero and
    are one group. A null doc_id counts as smaller than any other; the
    component_id of a group that holds one is null. Repeated rows come out
    as often as they come in.
    """
    rows = kept(fingerprints(docs, words, bits), "fingerprints")
    nodes = kept(rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(NO_ID))).alias("node")), "nodes")
    group = components(links(nodes, bits, parts, agree, distance))
    named = nodes.join(group, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", F.nullif("component_id", F.lit(NO_ID)).alias("component_id"))


def deduplicated(docs: DataFrame, similarity: float | None = None, **settings) -> DataFrame:
    """The rows of one document of each group: that of the smallest doc_id (null counts as smallest).

    Groups are those of `alike` if a similarity is given, else of `near_duplicates`.

    Of rows that share this id one stays, the first by its further columns. All
    columns stay as they are.
    """
    grouped = near_duplicates(docs, **settings) if similarity is None else alike(docs, similarity=similarity, **settings)
    found = grouped.select("doc_id", (F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"))
    ids = found.groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("n")).where("NOT kept OR n > 1")
    name, row = unused(docs, "other_id"), unused(docs, "row")
    # the ids that go are fewer than those that stay, and few enough ids repeat
    others = kept(ids.select(F.col("doc_id").alias(name), (F.col("kept") & (F.col("n") > 1)).alias("again")), "others")

    def of(wanted: DataFrame, how: str) -> DataFrame:
        return docs.join(wanted.select(name), docs["doc_id"].eqNullSafe(F.col(name)), how)

    repeated = others.where("again")
    if repeated.isEmpty():
        return of(others, "left_anti")
    first = Window.partitionBy("doc_id").orderBy(*[F.col(c) for c in docs.columns if c != "doc_id"])
    return of(others, "left_anti").union(of(repeated, "left_semi").withColumn(row, F.row_number().over(first)).where(F.col(row) == 1).drop(row))
