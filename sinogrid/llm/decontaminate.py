"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised words; a run of them is one)
and units (after a number) turn into typed placeholders, all else is
lower-cased. Capitals that begin a sentence are read both ways, as plain words
and as names. Windows of `words` template words, and windows of the words as
they are, are hashed, and those of documents are joined with those of benchmark
items. Along an alignment, in which words may be put in or left out, each value
of an item's placeholders must have one value in the document; windows with
another value do not count, and a name without any rejects the alignment. So a
question asked with other numbers or names is found, and texts that only share a
pattern are not.

A word that no benchmark item has, and that is no number, unit or capital, is in
no window that matches. Each task cuts the documents at such words, which leaves
few stretches of the length of a window, and drops most windows of these by their
hashes. Both go by bitmaps of fixed size that the benchmark fills; what passes is
joined exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sinogrid.llm.tables import stored, texts, unused

#: fixed values: units of measure, as words that may follow a number
UNITS = frozenset("""mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers
 kilometre kilometres centimeter centimeters g kg mg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes
 s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years ml l liter liters litre litres
 gallon gallons cup cups dollar dollars usd euro euros eur cent cents percent degree degrees mph kph kmh hz khz mhz w kw v mv""".split())
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|[^\W\d_]+|[.!?\n]")
_LITERAL, _NUMBER, _CAPITAL, _MARK = range(4)
_KIND = np.uint64(62)
_LOW = np.uint64(2**62 - 1)
_PLACE = {k: np.uint64(int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "little") >> 2) for k in ("<number>", "<name>", "<unit>")}
_NO_WORD = np.uint64(int.from_bytes(hashlib.blake2b(b"<no word>", digest_size=8).digest(), "little") >> 2)
_VERBATIM = np.uint64(0x2545F4914F6CDD1D >> 2)
_FACTOR = 0x9E3779B97F4A7C15
_MAP_BITS = 24
_WORD_BITS = 22
_CACHED = 300_000
#: words of texts that are looked at together
_AT_ONCE = 1 << 18


class _Vocabulary(dict):
    """Token -> kind in the two highest bits, hash of the lower-cased token below."""

    def __missing__(self, token: str) -> int:
        if token in ".!?\n":
            kind = _MARK
        elif token[0].isdigit():
            kind = _NUMBER
        else:
            kind = _CAPITAL if token[0].isupper() else _LITERAL
        word = xxhash.xxh3_64_intdigest(token.lower().encode()) >> 2
        self[token] = found = kind << 62 | word
        return found


_UNIT_HASHES = np.array(sorted(_Vocabulary().__missing__(u) for u in UNITS), dtype=np.uint64)


class Words:
    """Words of a text: codes, kinds, and which capitals begin a sentence, so that they may be names or not."""

    def __init__(self, text: str, vocabulary: _Vocabulary):
        tokens = _TOKEN.findall(text)
        codes = np.fromiter(map(vocabulary.__getitem__, tokens), np.uint64, len(tokens))
        kinds = codes >> _KIND
        self.keep = np.nonzero(kinds != _MARK)[0]
        first = np.ones(len(tokens), bool)
        first[1:] = kinds[:-1] == _MARK
        self.tokens, self.kinds, self.codes = tokens, kinds[self.keep], codes[self.keep] & _LOW
        self.starts = first[self.keep] & (self.kinds == _CAPITAL)

    def word(self, i: int) -> str:
        return self.tokens[self.keep[i]].lower()


def _word_slot(codes: np.ndarray) -> np.ndarray:
    return (codes >> np.uint64(62 - _WORD_BITS)).astype(np.int64)


def _has(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether a window's hash has its bit in a bitmap of 2**_MAP_BITS bits, which stays packed: 2 MB in each worker."""
    slot = (hashes >> np.uint64(64 - _MAP_BITS)).astype(np.int64)
    return (packed[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


def _hashed(codes: np.ndarray, size: int) -> np.ndarray:
    n = len(codes) - size + 1
    total = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for j in range(size):
            total = total * np.uint64(_FACTOR) + codes[j:j + n]
        total ^= total >> np.uint64(29)
        total *= np.uint64(_FACTOR)
        total ^= total >> np.uint64(32)
    return total


class Stretches(Words):
    """Of several texts the longest runs, of `least` words or more, of numbers, capitals and words with a bit in `known`.

    After each run stands a word that no text has, as one that no item has ends
    it in its text. Neither is a name, number or unit, so readings of a run are
    those of the text, and no window across runs has the hash of an item's.
    """

    def __init__(self, known: np.ndarray, least: int):
        self.known, self.least, self.volume = known, least, 0
        self.tokens, self.parts = [], []

    def add(self, row: int, words: Words) -> None:
        self.volume += len(words.tokens)
        able = np.zeros(len(words.codes) + 2, np.int8)
        able[1:-1] = (words.kinds != _LITERAL) | self.known[_word_slot(words.codes)]
        edges = np.flatnonzero(np.diff(able))
        begins, ends = edges[::2], edges[1::2]
        long = ends - begins >= self.least
        begins, sizes = begins[long], ends[long] - begins[long] + 1  # the word after it included
        if not len(sizes):
            return
        place = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        last = np.cumsum(sizes) - 1
        at = place.copy()
        at[last] -= 1
        kinds, codes, starts = words.kinds[at], words.codes[at], words.starts[at]
        kinds[last], codes[last], starts[last] = _LITERAL, _NO_WORD, False
        tokens = words.tokens
        self.tokens += [tokens[k] for k in words.keep[at].tolist()]
        self.parts.append((kinds, codes, starts, place, np.full(len(at), row)))

    def joined(self) -> Stretches:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.int64), np.zeros(0, np.int64))
        self.kinds, self.codes, self.starts, self.place, self.row = (np.concatenate(x) for x in zip(none, *self.parts))
        self.keep = np.arange(len(self.tokens))
        return self


class Template:
    """Template words of one reading: hashes, which are placeholders, and where each begins; a run of names is one placeholder.

    `named`: the sentence starts that are read as names; without it the words are taken as they are.
    """

    def __init__(self, words: Words, named: np.ndarray | None):
        self.words, codes, n = words, words.codes, len(words.codes)
        self.at, self.hashes, self.slot = np.arange(n + 1), codes ^ _VERBATIM, np.zeros(n, bool)
        self.verbatim = named is None
        if self.verbatim:
            return
        number, name = words.kinds == _NUMBER, (words.kinds == _CAPITAL) & (~words.starts | named)
        unit = np.zeros(n, bool)
        after = np.flatnonzero(number[:-1] & (words.kinds[1:] == _LITERAL)) + 1
        unit[after] = np.isin(codes[after], _UNIT_HASHES)
        hashes, slot = codes.copy(), number | name | unit
        for which, value in ((number, "<number>"), (name, "<name>"), (unit, "<unit>")):
            hashes[which] = _PLACE[value]
        head = np.ones(n, bool)
        head[1:] = ~(name[1:] & name[:-1])
        heads = np.nonzero(head)[0]
        self.at, self.hashes, self.slot = np.append(heads, n), hashes[heads], slot[heads]

    def values(self, start: int, size: int) -> list[str]:
        """Values of the placeholders of a window: @ a sure name, ^ a sentence start, # any other; place in the window, lower-cased words."""
        out, w = [], self.words
        for i in range(start, start + size):
            if self.slot[i]:
                a, b = self.at[i], self.at[i + 1]
                sign = "#" if w.kinds[a] != _CAPITAL else "^" if w.starts[a:b].all() else "@"
                out.append(f"{sign}{a - self.at[start]}:{' '.join(w.word(k) for k in range(a, b))}")
        return out

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows of which at least half are plain words."""
        total = _hashed(self.hashes, size)
        if not len(total):
            return np.zeros(0, np.int64), total
        filled = np.concatenate([[0], np.cumsum(self.slot)])
        starts = np.nonzero(2 * (filled[size:] - filled[:-size]) <= size)[0]
        return starts, total[starts]

    def rows(self, name: int, size: int, starts: list[int], hashes: list[int]) -> list[tuple]:
        return [(name, size, int(self.at[p]), int(self.at[p + size] - self.at[p]), h, self.values(p, size)) for p, h in zip(starts, hashes)]


def readings(words: Words, apart: bool = False) -> list[Template]:
    """Words as they are, and templates with sentence starts as plain words and as names; `apart`: the first word by itself."""
    none = np.zeros(len(words.codes), bool)
    named = [none, words.starts] if words.starts.any() else [none]
    if apart and len(none):
        # a text that quotes an item may have its first word in the middle of a sentence, as a name or not
        own = none.copy()
        own[0] = words.starts[0]
        named += [own, words.starts & ~own]
    return [Template(words, n) for n in [None, *named]]


_WINDOW = "size int, pos int, width int, hash long, vals array<string>"


def _columns(found: list[tuple], first: str, kind: pa.DataType) -> pa.RecordBatch:
    kinds = (kind, pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*found) if found else [[]] * 6, kinds)],
                                      names=[first, "size", "pos", "width", "hash", "vals"])


def _size(n: int, words: int, least: int) -> int:
    """Window size of an item of n words: short ones in one piece, then what lets one changed word in the middle leave a half."""
    return n if n <= words else min(words, max(least, n // 2))


def item_windows(benchmark: DataFrame, words: int = 8, least: int = 5) -> DataFrame:
    """(item, length, size, pos, width, hash, vals) of all items, in words.

    Items are given verbatim and as templates, those of fewer than `least`
    words verbatim alone.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, lengths, vocabulary = [], [], _Vocabulary()
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = Words(text, vocabulary)
                n = len(found.codes)
                size = _size(n, words, least)
                for t in readings(found, apart=True) if n else []:
                    sizes = {size} if t.verbatim or n >= least else set()
                    if not t.verbatim and least <= len(t.hashes) < size:
                        sizes = {len(t.hashes)}
                    for k in sizes:
                        starts, hashes = t.windows(k)
                        out += t.rows(item, k, starts.tolist(), hashes.view(np.int64).tolist())
                lengths += [n] * (len(out) - len(lengths))
            yield _columns(out, "item", pa.int64()).append_column("length", pa.array(lengths, pa.int32()))

    rows = benchmark.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, f"item long, {_WINDOW}, length int").dropDuplicates(["item", "size", "pos", "hash"])


def _known_words(benchmark: DataFrame) -> bytes:
    """2**_WORD_BITS bits, set where the hashes of the items' words and of the units say."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, seen = _Vocabulary(), np.zeros(2**_WORD_BITS, bool)
        for batch in batches:
            for text in batch.column(0):
                seen[_word_slot(Words(text.as_py(), vocabulary).codes)] = True
                if len(vocabulary) > _CACHED:
                    vocabulary.clear()
        bits = np.packbits(seen, bitorder="little").view(np.int64)
        at = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(bits[at])], names=["word", "bits"])

    rows = benchmark.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).mapInArrow(words, "word int, bits long")
    packed = np.zeros(2**_WORD_BITS // 64, np.int64)
    for r in rows.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect():
        packed[r["word"]] = r["bits"]
    units = np.zeros(2**_WORD_BITS, bool)
    units[_word_slot(_UNIT_HASHES & _LOW)] = True
    return (packed | np.packbits(units, bitorder="little").view(np.int64)).tobytes()


def _same(a: str | None, b: str) -> bool:
    """Whether two values are one, or a name and the same with further words, as after a capital that isn't part of it."""
    return a is not None and (a == b or f" {b} ".endswith(f" {a} ") or f" {a} ".endswith(f" {b} "))


def _resolved(found: list[dict]) -> tuple[list[dict], int] | None:
    """The windows in which each item value has its one document value, and the number of such values; None if a sure name has none.

    Its document value is the same value if that occurs, else the one of most places.
    """
    places: dict[str, dict[str, set[int]]] = {}
    sure = set()
    for m in found:
        for ours, theirs in zip(m["ours"], m["theirs"]):
            (place, own), (_, other) = ours[1:].split(":", 1), theirs[1:].split(":", 1)
            places.setdefault(own, {}).setdefault(other, set()).add(m["pos"] + int(place))
            if ours[0] == "@":
                sure.add(own)
    value = {}
    for own, others in places.items():
        most = max(map(len, others.values()))
        top = [own] if own in others else sorted((o for o, p in others.items() if len(p) == most), key=len)
        if all(_same(top[0], o) for o in top):
            value[own] = top[0]
        elif own in sure:
            return None
    good = [m for m in found if all(_same(value.get(a.split(":", 1)[1]), b.split(":", 1)[1]) for a, b in zip(m["ours"], m["theirs"]))]
    return good, len({a.split(":", 1)[1] for m in good for a in m["ours"]})


def best_alignment(found: list[dict], length: int) -> tuple[int, int, int]:
    """(covered words, matched windows, values) of the best band of shifts, half an item wide: words put in or left out move the rest."""
    found = sorted(found, key=lambda m: m["at"] - m["pos"])
    shifts = [m["at"] - m["pos"] for m in found]
    best, end = (0, 0, 0), 0
    for start in range(len(found)):
        if start and shifts[start] == shifts[start - 1]:
            continue
        before = end
        while end < len(found) and shifts[end] <= shifts[start] + length // 2:
            end += 1
        if end == before:
            continue  # part of the band before
        kept = _resolved(found[start:end])
        if kept is not None:
            covered = {w for m in kept[0] for w in range(m["pos"], m["pos"] + m["width"])}
            best = max(best, (len(covered), len({m["pos"] for m in kept[0]}), kept[1]))
    return best


def matches(docs: DataFrame, benchmark: DataFrame, words: int = 8, least: int = 5, coverage: float = 0.5) -> DataFrame:
    """(doc_id, item_id, matched, windows, coverage, slots): one row for each document that holds an item.

    coverage is the share of the item's words in windows that agree along the
    best alignment, at least `coverage`; matched of the item's `windows` do, and
    slots is the number of their different placeholder values, each of which has
    one value in the document. Items of equal windows are joined once and
    reported each.

    Null texts are empty, and match nothing. Items of fewer than `least` words
    match word for word. Rows with one doc_id count as one document, null ids
    too. Empty tables give no rows; further columns are left out.
    """
    spark = docs.sparkSession
    items = stored(item_windows(benchmark, words, least), "items")
    totals = items.groupBy("item", "length").agg(F.countDistinct("pos").alias("windows"), F.sort_array(F.collect_list(F.struct("pos", "size", "hash", "vals"))).alias("all"))
    classes = stored(totals.withColumn("cls", F.min("item").over(Window.partitionBy("all"))).select("item", "cls", "windows", "length"), "items")
    one = items.join(classes.where("item = cls").select("item"), "item")
    slot = F.shiftrightunsigned("hash", 64 - _MAP_BITS)
    bits = (items.groupBy(F.shiftright(slot, 6).alias("word"))
            .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 64).cast("int"))).alias("bits")).collect())
    packed = np.zeros(2**_MAP_BITS // 64, np.int64)
    for r in bits:
        packed[r["word"]] = r["bits"]
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())
    shared = spark.sparkContext.broadcast((packed.tobytes(), _known_words(benchmark)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, known = (np.frombuffer(x, np.uint8) for x in shared.value)
        known = np.unpackbits(known, bitorder="little").view(bool)  # asked for every word
        vocabulary, shortest = _Vocabulary(), min(sizes, default=1)

        def hits(held: Stretches, docs: list) -> list[tuple]:
            out, own = [], set()
            for t in readings(held.joined()):
                for size in sizes if t.verbatim else [k for k in sizes if k >= least]:
                    starts, hashes = t.windows(size)
                    hit = np.nonzero(_has(seen, hashes))[0]
                    for _, *row in t.rows(0, size, starts[hit].tolist(), hashes[hit].view(np.int64).tolist()):
                        key = row[1], row[0], row[3]  # a place of all texts
                        if key not in own:
                            own.add(key)
                            row[1] = int(held.place[key[0]])
                            out.append((docs[held.row[key[0]]], *row))
            return out

        for batch in batches:
            out, docs, held = [], batch.column(0).to_pylist(), Stretches(known, shortest)
            for row, text in enumerate(batch.column(1)):
                if len(vocabulary) > _CACHED:
                    vocabulary.clear()
                held.add(row, Words(text.as_py(), vocabulary))
                if held.volume > _AT_ONCE:
                    out, held = out + hits(held, docs), Stretches(known, shortest)
            yield _columns(out + hits(held, docs), "doc", pa.int64())

    @F.arrow_udf("struct<covered: int, matched: int, slots: int>")
    def aligned(found: pa.Array, length: pa.Array) -> pa.Array:
        best = [best_alignment(m, n) for m, n in zip(found.to_pylist(), length.to_pylist())]
        return pa.StructArray.from_arrays([pa.array([b[k] for b in best], pa.int32()) for k in range(3)], ["covered", "matched", "slots"])

    found = texts(docs).mapInArrow(cut, f"doc long, {_WINDOW}")
    joined = (found.select("doc", "size", "hash", F.col("pos").alias("at"), F.col("vals").alias("theirs"))
              .join(one.select("item", "length", "size", "hash", "pos", "width", F.col("vals").alias("ours")), ["size", "hash"]))
    best = (joined.groupBy("doc", "item", "length").agg(F.collect_set(F.struct("pos", "width", "at", "ours", "theirs")).alias("found"))
            .select("doc", "item", aligned("found", "length").alias("b")))
    return (best.join(classes.withColumnRenamed("item", "item_id"), F.col("item") == F.col("cls"))
            .select(F.col("doc").alias("doc_id"), "item_id", F.col("b.matched").cast("long").alias("matched"), "windows",
                    (F.col("b.covered") / F.col("length")).alias("coverage"), F.col("b.slots").cast("long").alias("slots"))
            .where(F.col("coverage") >= coverage))


def clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """Documents that hold no benchmark item; their columns and rows as they are."""
    name = unused(docs, "bad_id")
    bad = stored(matches(docs, benchmark, **settings).select(F.col("doc_id").alias(name)).distinct(), "bad")
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col(name)), "left_anti")
