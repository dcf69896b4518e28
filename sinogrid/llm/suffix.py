"""Repeated byte strings by suffix arrays: what is covered by a string that starts earlier goes.

Strings of `length` bytes that are equal lie anywhere in the corpus, so they are
first brought together. Every window of `length` bytes chooses an anchor: of the
`gram`-byte strings in it the one of the smallest hash, the first of ties. Equal
windows choose equal anchors at equal places, and the windows of one anchor
occurrence are a run, whose bytes are its context (about 135).

1. Anchors are hashed and counted; those that occur once can have no equal window.
2. Occurrences of equal contexts form a class. All of its windows but those of
   the earliest occurrence are repeats. Only the earliest ones move back to their
   documents, whose other places are the repeats.
3. Where classes share an anchor, their earliest contexts meet in one task, which
   sorts their suffixes and finds the windows in common. Anchors with more than
   `most` classes (a passage that countless documents quote, each in its own
   setting) are compared window by window instead, by a digest that sums up
   before the shuffle, so that no group has to fit into a task.

Suffixes are sorted by the linear grouping construction: groups of suffixes with
equal Lyndon prefixes are handled in falling order, each group refines the groups
of its members' previous smaller suffixes, and one pass then emits all groups in
order, with no renaming and no recursion.

Which anchors or occurrences the later passes need is sent as bitmaps of fixed
size; what they let through by chance is sorted out by the joins that follow.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinogrid.llm.tables import NO_ID, discarded, kept, texts

_MAP_BITS = 26
_FACTOR = 0x9E3779B97F4A7C15
#: one 64-bit word for each byte value
_WORDS = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=8).digest() for b in range(256)), np.uint64)
_CHUNK = 1 << 19
_ROWS_AT_ONCE = 20_000


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in rising order; `symbols` end with a 0, which occurs nowhere else."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(symbols))])[:-1]
    group = first[symbols].tolist()
    size = [0] * n
    for start, count in zip(*np.unique(group, return_counts=True)):
        size[start] = int(count)
    where = np.empty(n, np.int64)
    where[order] = np.arange(n)
    order, where = order.tolist(), where.tolist()
    prev = [-1] * n  # -1 is also the place of the last suffix, whose group is the lowest: no pointer passes it
    end = n
    while end:
        start = group[order[end - 1]]
        if end - start == 1:
            i = order[start]
            p = i - 1
            while group[p] > start:
                p = prev[p]
            prev[i] = p
            end = start
            if p >= 0 and size[h := group[p]] > 1:
                size[h] -= 1
                last, at = h + size[h], where[p]
                if at != last:
                    order[at] = other = order[last]
                    where[other] = at
                    order[last] = p
                    where[p] = last
                group[p] = last
                size[last] = 1
            continue
        count: dict[int, int] = {}
        for i in sorted(order[start:end]):
            p = i - 1
            while group[p] > start:
                p = prev[p]
            if group[p] == start and p >= 0:
                p = prev[p]
            prev[i] = p
            if p >= 0:
                count[p] = count.get(p, 0) + 1
        end = start
        if not count:
            continue
        times = set(count.values())
        for wanted in sorted(times, reverse=True):
            moved: dict[int, int] = {}
            for j in count if len(times) == 1 else [j for j, c in count.items() if c == wanted]:
                h = group[j]
                size[h] -= 1
                last, at = h + size[h], where[j]
                other = order[last]
                order[at], where[other] = other, at
                order[last], where[j] = j, last
                moved[h] = moved.get(h, 0) + 1
            for h, k in moved.items():
                new = h + size[h]
                if new != h:
                    for j in order[new:new + k]:
                        group[j] = new
                size[new] = k
    # emit: what stands before a placed suffix is the next of its group, and so are its previous smaller ones
    out, head, placed = [-1] * n, list(range(n)), bytearray(n)
    out[0] = n - 1
    head[0] = 1
    placed[n - 1] = 1
    for at in range(n):
        j = out[at] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            out[head[g]] = j
            head[g] += 1
            placed[j] = 1
            j = prev[j]
    return np.array(out, dtype=np.int64)


def repeated_windows(contexts: list[bytes], places: list[int], length: int) -> np.ndarray:
    """For all windows of all contexts, one after the other: whether an earlier context has an equal window.

    `places` are those of the anchors in the contexts. Equal windows have their
    anchors at equal places, so the contexts are read as words of 8 bytes counted
    from there, and suffixes of words are sorted. A window holds at least
    (length - 7) // 8 whole words; those that agree in them are told apart by
    their remaining bytes at both ends.
    """
    core = (length - 7) // 8
    sizes, places_ = np.array([len(c) for c in contexts]), np.array(places)
    skip = places_ % 8  # bytes before the first whole word
    words = (sizes - skip) // 8
    raw = np.frombuffer(b"".join(contexts) + b"\0" * 8, np.uint8)
    starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    texts_at = np.concatenate([[0], np.cumsum(words + 1)])
    within = np.arange(texts_at[-1]) - np.repeat(texts_at[:-1], words + 1)
    real = within < np.repeat(words, words + 1)
    at = (np.repeat(starts + skip, words + 1) + 8 * within)[real]
    values = raw[at[:, None] + np.arange(8)].view(np.uint64)[:, 0]
    symbols = np.ones(texts_at[-1] + 1, np.int64)  # 1 between contexts
    symbols[:-1][real] = np.unique(values, return_inverse=True)[1] + 2
    symbols[-1] = 0
    # rank of the words that begin at each place: equal for equal runs of `core` words
    order = suffix_array(symbols)
    enough = np.zeros(len(symbols), bool)
    enough[:-1] = within + core <= np.repeat(words, words + 1)
    order = order[enough[order]]
    views = np.lib.stride_tricks.sliding_window_view(np.append(symbols, np.zeros(core, np.int64)), core)
    differs = np.ones(len(order), np.int64)
    if len(order) > 1:
        differs[1:] = (views[order[1:]] != views[order[:-1]]).any(axis=1)
    group = np.full(len(symbols), -1, np.int64)
    group[order] = np.cumsum(differs)
    # windows: the run of whole words in each, and the bytes beside it
    counts = sizes - length + 1
    begin = np.arange(counts.sum()) - np.repeat(np.concatenate([[0], np.cumsum(counts)])[:-1], counts)
    lead = (np.repeat(places_, counts) - begin) % 8
    first = (begin + lead - np.repeat(skip, counts)) // 8 + np.repeat(texts_at[:-1], counts)
    offset = np.repeat(starts, counts) + begin
    rest = length - 8 * core
    beside = np.arange(rest)[None, :] + np.where(np.arange(rest)[None, :] < lead[:, None], 0, 8 * core)
    edge = np.zeros((len(begin), 16), np.uint8)
    edge[:, :rest] = raw[offset[:, None] + beside]
    ends = edge.view(np.uint64)
    key = group[first] * 8 + lead
    order = np.lexsort((np.arange(len(key)), ends[:, 1], ends[:, 0], key))
    out = np.zeros(len(key), bool)
    same = (key[order[1:]] == key[order[:-1]]) & (ends[order[1:]] == ends[order[:-1]]).all(axis=1)
    out[order[1:][same]] = True
    return out


def anchors(data: bytes, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first window, last window) of each anchor occurrence of a text, as arrays."""
    parts, n = [], len(data) - length + 1
    for at in range(0, max(0, n), _CHUNK):
        parts.append(_anchors(np.frombuffer(data, np.uint8, min(len(data) - at, _CHUNK + length - 1), at), length, gram, at))
    if not parts:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    h, a, s, e = (np.concatenate(x) for x in zip(*parts))
    cut = np.nonzero(a[1:] == a[:-1])[0]  # one occurrence on both sides of a chunk's end
    if len(cut):
        e[cut] = e[cut + 1]
        keep = np.ones(len(a), bool)
        keep[cut + 1] = False
        h, a, s, e = h[keep], a[keep], s[keep], e[keep]
    return h, a, s, e


def _anchors(data: np.ndarray, length: int, gram: int, base: int):
    h, width, factor = _WORDS[data], 1, _FACTOR
    while width < gram:  # gram is a power of two
        h = h[:-width] * np.uint64(factor) + h[width:]
        width, factor = 2 * width, factor * factor % 2**64
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    span, n = length - gram + 1, len(data) - length + 1
    key = h & np.uint64(2**64 - 2**20) | np.arange(len(h), dtype=np.uint64)
    full = np.full(-(-len(key) // span) * span, 2**64 - 1, np.uint64)
    full[:len(key)] = key
    rows = full.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    place = (np.minimum(behind[:n], ahead[span - 1:span - 1 + n]) & np.uint64(2**20 - 1)).astype(np.int64)
    begin = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1])
    a = place[begin]
    return h[a], a + base, begin + base, np.concatenate([begin[1:], [n]]) - 1 + base


def _slot(hashes: np.ndarray) -> np.ndarray:
    """Place in a bitmap: the trailing bits, as anchors are the smallest hashes around and their leading bits are alike."""
    return (hashes & np.uint64(2**_MAP_BITS - 1)).astype(np.int64)


def _bitmap(hashes: DataFrame, name: str) -> bytes:
    """2**_MAP_BITS bits, set where a hash's trailing bits say; summed up by words before they reach the driver."""
    slot = F.col(name).bitwiseAND(F.lit(2**_MAP_BITS - 1))
    rows = (hashes.groupBy(F.shiftright(slot, 6).cast("int").alias("w"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("bits")))
    out = np.zeros(2**_MAP_BITS // 64, np.int64)
    for r in rows.toLocalIterator():
        out[r["w"]] = r["bits"]
    return out.tobytes()


def _has(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = _slot(hashes)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _batch(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)],
                                      names=[n for n, _ in kinds])


_ID = [("id", pa.int64()), ("tie", pa.int64())]
_WHERE = "id long, tie long"


def _occurrence(g: int, tie: int, place: int) -> int:
    """One 64-bit name for an anchor occurrence."""
    return xxhash.xxh3_64_intdigest(np.array([g, tie, place], np.uint64).tobytes())


def _late_runs(places: DataFrame, firsts: DataFrame) -> DataFrame:
    """(id, tie, lo, hi): the places (arrays lo, more; more = hi - lo is small and packs well) of each document that are not among its `firsts`; what touches or overlaps is one."""
    @F.arrow_udf("array<struct<lo: int, hi: int>>")
    def joined(lo: pa.Array, more: pa.Array, first: pa.Array) -> pa.Array:
        out = []
        for a, b, f in zip(lo, more, first):
            a, b = np.asarray(a.as_py(), np.int64), np.asarray(b.as_py(), np.int64)
            b += a
            late = ~np.isin(a, np.asarray(f.as_py() or [], np.int64))
            a, b = a[late], b[late]
            order = np.argsort(a)
            a, b = a[order], np.maximum.accumulate(b[order])
            cut = np.ones(len(a), bool)
            cut[1:] = a[1:] > b[:-1] + 1
            ends = np.append(cut[1:], True)[:len(a)]
            out.append([{"lo": x, "hi": y} for x, y in zip(a[cut].tolist(), b[ends].tolist())])
        return pa.array(out, pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())])))

    own = firsts.groupBy("f.id", "f.tie").agg(F.collect_list("f.lo").alias("first"))
    rows = places.select("id", "tie", "lo", "more").join(own, ["id", "tie"], "left")
    return rows.select("id", "tie", F.explode(joined("lo", "more", "first")).alias("r")).select("id", "tie", "r.lo", "r.hi")


def repeated(docs: DataFrame, length: int = 100, gram: int = 32, most: int = 2048) -> DataFrame:
    """(id, tie, lo, hi): runs of window starts of which each window also starts earlier.

    docs: (id, tie, data), rows in the order of (id, tie); rows equal in both are one document.
    """
    spark = docs.sparkSession

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [anchors(t.as_py(), length, gram)[0] for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64) if found else [], pa.int64())], names=["g"])

    often = kept(docs.mapInArrow(counted, "g long").groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "grams")
    shared = spark.sparkContext.broadcast(_bitmap(often, "g"))
    discarded(often)

    def classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.frombuffer(shared.value, np.uint8)
        kinds = [*_ID, *((n, pa.list_(k)) for n, k in (("g", pa.int64()), ("c", pa.int64()), ("lo", pa.int32()), ("more", pa.int32())))]
        for batch in batches:
            out, held = [], 0
            for id_, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.as_py()
                h, a, s, e = anchors(data, length, gram)
                at = np.nonzero(_has(seen, h))[0]
                if not len(at):
                    continue
                lo, hi = s[at], e[at]
                c = [xxhash.xxh3_64_intdigest(data[x:y + length], z - x) - 2**63 for x, y, z in zip(lo.tolist(), hi.tolist(), a[at].tolist())]
                out.append((id_, tie, h[at].view(np.int64), np.array(c, np.int64), lo.astype(np.int32), (hi - lo).astype(np.int32)))
                held += len(at)
                if held > _ROWS_AT_ONCE:
                    yield _batch(out, kinds)
                    out, held = [], 0
            yield _batch(out, kinds)

    places = kept(docs.mapInArrow(classed, f"{_WHERE}, g array<long>, c array<long>, lo array<int>, more array<int>"), "places")
    each = places.select("id", "tie", F.explode(F.arrays_zip("g", "c", "lo")).alias("p"))
    firsts = kept(each.select("p.g", "p.c", F.struct("id", "tie", "p.lo").alias("f")).groupBy("g", "c").agg(F.min("f").alias("f")).drop("c"), "classes")
    copies = kept(_late_runs(places, firsts), "copies")
    discarded(places)
    several = firsts.groupBy("g").agg(F.count("*").alias("classes")).where("classes > 1")
    open_ = firsts.join(several, "g").select("g", F.col("f.id").alias("id"), F.col("f.tie").alias("tie"), F.col("f.lo").alias("lo"), "classes")
    open_ = kept(open_, "open")
    discarded(firsts)

    @F.arrow_udf("long")
    def named(g: pa.Array, tie: pa.Array, lo: pa.Array) -> pa.Array:
        rows = zip(*(x.cast(pa.int64()).to_numpy(zero_copy_only=False).view(np.uint64).tolist() for x in (g, tie, lo)))
        return pa.array(np.array([_occurrence(*r) for r in rows], np.uint64).view(np.int64), pa.int64())

    wanted = spark.sparkContext.broadcast(_bitmap(open_.select(named("g", "tie", "lo").alias("o")), "o"))

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, need = np.frombuffer(shared.value, np.uint8), np.frombuffer(wanted.value, np.uint8)
        kinds = [*_ID, ("g", pa.int64()), ("lo", pa.int32()), ("place", pa.int32()), ("data", pa.binary())]
        for batch in batches:
            out = []
            for id_, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                data = text.as_py()
                h, a, s, e = anchors(data, length, gram)
                at = np.nonzero(_has(seen, h))[0]
                if len(at):
                    names = np.array([_occurrence(g, tie % 2**64, lo) for g, lo in zip(h[at].tolist(), s[at].tolist())], np.uint64)
                    at = at[_has(need, names)]
                    out += [(id_, tie, g, lo, place - lo, data[lo:hi + length]) for g, place, lo, hi in
                            zip(h[at].view(np.int64).tolist(), a[at].tolist(), s[at].tolist(), e[at].tolist())]
                if len(out) > _ROWS_AT_ONCE:
                    yield _batch(out, kinds)
                    out = []
            yield _batch(out, kinds)

    met = docs.mapInArrow(contexts, f"{_WHERE}, g long, lo int, place int, data binary").join(open_, ["g", "id", "tie", "lo"]).dropDuplicates(["g", "id", "tie", "lo"])
    met = kept(met, "contexts")
    discarded(open_)

    def sorted_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, volume, last = [], 0, None

        def runs() -> pa.RecordBatch:
            out = []
            again = repeated_windows([x[-1] for x in held], [x[-2] for x in held], length)
            at = 0
            for id_, tie, lo, _, data in held:
                n = len(data) - length + 1
                edge = np.flatnonzero(np.diff(np.concatenate([[0], again[at:at + n], [0]])))
                out += [(id_, tie, lo + a, lo + b - 1) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
                at += n
            return _batch(out, [*_ID, ("lo", pa.int32()), ("hi", pa.int32())])

        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("g", "id", "tie", "lo", "place", "data"))):
                if g != last and volume > 1 << 14:
                    yield runs()
                    held, volume = [], 0
                held.append(row)
                volume += len(row[-1])
                last = g
        if held:
            yield runs()

    few = (met.where(F.col("classes") <= most).repartition(F.col("g")).sortWithinPartitions("g", "id", "tie", "lo")
           .mapInArrow(sorted_out, f"{_WHERE}, lo int, hi int"))
    at = F.explode(F.sequence(F.lit(0), F.octet_length("data") - length)).alias("k")
    many = (met.where(F.col("classes") > most).select("id", "tie", "lo", "data", at)
            .select("id", "tie", (F.col("lo") + F.col("k")).alias("lo"), F.md5(F.expr(f"substring(data, k + 1, {length})")).alias("w")))
    earliest = many.groupBy("w").agg(F.min(F.struct("id", "tie", "lo")).alias("f"), F.count("*").alias("n")).where("n > 1").drop("n")
    late = many.join(earliest, "w").where("NOT (id = f.id AND tie = f.tie AND lo = f.lo)").select("id", "tie", "lo", F.col("lo").alias("hi"))
    ranges = kept(few.union(late), "ranges")
    discarded(met)
    return copies.union(ranges)


def without_repeats(docs: DataFrame, length: int = 100, **settings) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the bytes kept of each document.

    Null texts are empty; texts shorter than `length` stay whole. A null doc_id
    is smaller than any other. Documents of one id are ordered by a hash of their
    text; rows equal in both are one document, and each of them gets its result.
    Further columns are left out; a table without rows gives none.
    """
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64("text").alias("tie"), F.col("text").cast("binary").alias("data"))
    if rows.groupBy("id").agg(F.min("tie").alias("a"), F.max("tie").alias("b")).where("a < b").isEmpty():
        rows = rows.withColumn("tie", F.lit(0).cast("long"))  # ids alone tell documents apart
    gone = (repeated(rows, length, **settings).groupBy("id", "tie")
            .agg(F.collect_list("lo").alias("lo"), F.collect_list("hi").alias("hi")))

    @F.arrow_udf("struct<n_bytes: long, n_removed: long, n_spans: long, kept_sha256: string, kept: binary>")
    def cut(data: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
        out = []
        for t, a, b in zip(data, lo, hi):
            raw = np.frombuffer(t.as_py(), np.uint8)
            edge = np.zeros(len(raw) + 1, np.int64)
            if a.is_valid:
                np.add.at(edge, np.asarray(a.as_py(), np.int64), 1)
                np.add.at(edge, np.asarray(b.as_py(), np.int64) + length, -1)
            cover = np.cumsum(edge[:-1]) > 0
            kept = raw[~cover].tobytes()
            spans = int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum()) if len(raw) else 0
            out.append((len(raw), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        kinds = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]
        return pa.StructArray.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*out) if out else [[]] * 5, kinds)], [n for n, _ in kinds])

    return (rows.join(gone, ["id", "tie"], "left").select(F.nullif("id", F.lit(NO_ID)).alias("doc_id"), cut("data", "lo", "hi").alias("r"))
            .select("doc_id", "r.*"))
