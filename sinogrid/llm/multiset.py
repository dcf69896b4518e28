"""Homomorphic multiset hash of documents: the sum of vectors hashed from their paragraphs.

A fingerprint is a vector of sums modulo powers of two, in two parts:

- 4 equality lanes modulo 2**64: each paragraph (a line of the text) adds 4
  words hashed from all of its bytes,
- 192 likeness lanes modulo 2**24: each 3-word shingle of a paragraph (the whole
  paragraph, if it has fewer words) adds +1 or -1 to every lane, as bits of its
  hash say.

Sums don't depend on order, a paragraph can be added or taken away without the
others, and a text's fingerprint is the sum of its parts'. Equal multisets of
paragraphs have equal fingerprints; unequal ones differ in the equality lanes
but for chance of about 2**-256. The mean product of the likeness lanes
estimates the shared shingles, so that their cosine is a likeness (standard
error about 0.07).
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinogrid.llm.simhash import bit_counts, remixed, shingle_hashes
from sinogrid.llm.tables import NO_ID, texts

EQUALITY, LIKENESS = 4, 192
_ROWS = LIKENESS // 64
_TOP, _HALF = 2**24, 2**23


class Fingerprint:
    """Sums of paragraphs; `+` and `-` of fingerprints are those of the multisets."""

    __slots__ = ("equal", "like")

    def __init__(self, equal=None, like=None):
        self.equal = np.zeros(EQUALITY, np.uint64) if equal is None else equal
        self.like = np.zeros(LIKENESS, np.int64) if like is None else like

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal + other.equal, (self.like + other.like) % _TOP)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.equal - other.equal, (self.like - other.like) % _TOP)

    def add(self, paragraph: bytes, times: int = 1) -> None:
        """Insert a paragraph, or delete it with times = -1."""
        digest = np.frombuffer(hashlib.blake2b(paragraph, digest_size=8 * EQUALITY).digest(), np.uint64)
        self.equal = self.equal + digest * np.uint64(times % 2**64)
        for hashes in shingle_hashes(paragraph, 3):
            self._shingles(hashes, times)

    def _shingles(self, hashes: np.ndarray, times: int = 1) -> None:
        signs = 2 * bit_counts(remixed(hashes, _ROWS)).reshape(-1) - len(hashes)
        self.like = (self.like + times * signs) % _TOP

    def text(self) -> str:
        lanes = self.like.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3]
        return base64.b64encode(self.equal.astype("<u8").tobytes() + lanes.tobytes()).decode()

    def likeness(self, other: Fingerprint) -> float:
        """0 to 1; 1 for equal fingerprints, and 0 against one without words."""
        if (self.equal == other.equal).all():
            return 1.0
        a, b = ((x.like + _HALF) % _TOP - _HALF for x in (self, other))
        size = float(np.sqrt(float(a @ a) * float(b @ b)))
        return min(1.0, max(0.0, float(a @ b) / size)) if size else 0.0


def parse(text: str) -> Fingerprint:
    raw = base64.b64decode(text)
    lanes = np.frombuffer(raw[8 * EQUALITY:], np.uint8).reshape(-1, 3).astype(np.int64)
    return Fingerprint(np.frombuffer(raw[:8 * EQUALITY], "<u8").copy(), lanes @ np.array([1, 2**8, 2**16]))


def fingerprint(text: str) -> Fingerprint:
    """Of a whole text; the empty text has one empty paragraph."""
    out, shingles = Fingerprint(), []
    words = np.zeros(EQUALITY, np.uint64)
    waiting = 0
    for paragraph in text.encode().split(b"\n"):
        words += np.frombuffer(hashlib.blake2b(paragraph, digest_size=8 * EQUALITY).digest(), np.uint64)
        for hashes in shingle_hashes(paragraph, 3):
            shingles.append(hashes)
            waiting += len(hashes)
        if waiting > 100_000:
            out._shingles(np.concatenate(shingles))
            shingles, waiting = [], 0
    if shingles:
        out._shingles(np.concatenate(shingles))
    out.equal = words
    return out


_OUT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
        " near_edited double, near_next double")


def _blocks(rows: DataFrame, per_block: int) -> tuple[DataFrame, int]:
    """Rows with `block`, rising as ids fall, and the number of blocks; the first rows of a block are also copied to the block before it.

    Blocks are cut at quantiles of the ids, about per_block rows each. Cut points
    and the first id of each block are all that reaches the driver and the tasks:
    16 bytes for per_block rows. A copy has `copy` = true and is there for the one
    row before it; the block before the first one is the last.
    """
    ids = rows.select("id")
    n = ids.count()
    wanted = max(1, -(-n // per_block))
    found = ids.approxQuantile("id", [k / wanted for k in range(1, wanted)], 0.1 / wanted) if wanted > 1 else []
    cuts = np.array(sorted(set(map(int, found))), dtype=np.int64)

    @F.arrow_udf("int")
    def block_of(id_: pa.Array) -> pa.Array:
        return pa.array(len(cuts) - np.searchsorted(cuts, id_.to_numpy(zero_copy_only=False)), pa.int32())

    tops = {r["block"]: r["top"] for r in ids.select(block_of("id").alias("block"), "id").groupBy("block").agg(F.max("id").alias("top")).collect()}
    order = sorted(tops)
    firsts = np.array([tops[k] for k in reversed(order)], dtype=np.int64)
    to = np.array([order[i - 1] for i in reversed(range(len(order)))], dtype=np.int32)

    @F.arrow_udf("array<int>")
    def blocks_of(id_: pa.Array) -> pa.Array:
        v = id_.to_numpy(zero_copy_only=False)
        own = len(cuts) - np.searchsorted(cuts, v)
        at = np.minimum(np.searchsorted(firsts, v), len(firsts) - 1)
        return pa.array([[o, t] if f == x else [o] for o, t, f, x in zip(own.tolist(), to[at].tolist(), firsts[at].tolist(), v.tolist())], pa.list_(pa.int32()))

    listed = rows.select("*", F.posexplode(blocks_of("id")).alias("copy", "block"))
    return listed.withColumn("copy", F.col("copy") == 1), len(cuts) + 1


def edited_likeness(docs: DataFrame, per_block: int = 8192) -> DataFrame:
    """Fingerprints of each document and of its edited text, and their likeness.

    The edited text has the last half of the code points replaced by the first as
    many (or all) of the next document's in falling order of doc_id, after the
    last the first. Texts move once, to blocks sorted by doc_id; the row that
    follows a block comes along as a copy.

    Null texts are empty. Rows with equal ids follow each other by text; null ids
    come last. One document is its own next one. Further columns are left out.
    """
    rows = texts(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "text")
    dealt, blocks = _blocks(rows, per_block)
    sorted_rows = (dealt.repartitionById(blocks, "block").select("block", "copy", "id", "text")
                   .sortWithinPartitions(F.col("block"), F.col("copy"), F.desc("id"), F.col("text")))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (block, id, text, fingerprint) whose next row is still to come

        def row(held, text, print_):
            half = len(held[2]) // 2
            edited = held[2][:len(held[2]) - half] + text[:half]
            other = fingerprint(edited)
            return (None if held[1] == NO_ID else held[1], len(held[2]), hashlib.sha256(edited.encode()).hexdigest(), held[3].text(), other.text(),
                    held[3].likeness(other), held[3].likeness(print_))

        kind = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                          ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        for batch in batches:
            out, (block, copy, ids, text) = [], (batch.column(i) for i in range(4))
            for i in range(batch.num_rows):
                b, c, d, t = block[i].as_py(), copy[i].as_py(), ids[i].as_py(), text[i].as_py()
                if held and held[0] != b:
                    raise ValueError(f"block {held[0]} has no row behind it")
                if c and not held:
                    continue  # further rows of the id that follows the block
                print_ = fingerprint(t)
                if held:
                    out.append(row(held, t, print_))
                held = None if c else (b, d, t, print_)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out) if out else [[]] * len(kind), kind)], schema=kind)

    return sorted_rows.mapInArrow(pairs, _OUT)
