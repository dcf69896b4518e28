"""Packing of tokenised documents into sequences by bounded-space online best fit.

Texts are tokenised where they lie and leave as pieces: lengths and checksums.
Pieces are then dealt at random into groups of about `per_group`, and each group
is packed by one task in one pass. A fixed number of sequences is open at a
time. A bitset has bit f set if some open sequence has f tokens free; the lowest
bit at or above a piece's length names the fullest sequence that can take it. If
none can, a new one is opened, and if too many are open, the fullest is closed.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinogrid.llm.tables import stored, texts


def tokenizer_path(name: str = "byte_bpe_50k") -> str:
    """A public vocabulary's .tiktoken file, by its place in the installed package."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.tiktoken")


class Tokens:
    """Byte-level BPE ids of a text, as the tokenizers library gives them without special tokens.

    The usual pattern looks ahead at white space, which is slow. Where no white
    space character follows another, the branch that does so never decides, and
    the pattern without it splits the text in the same way.
    """

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import regex
        import tiktoken

        ahead = r"|\s+(?!\S)"
        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        made = [tiktoken.Encoding(f"own{len(p)}", pat_str=p, mergeable_ranks=ranks, special_tokens={})
                for p in (public_tokenizers.PATTERN, public_tokenizers.PATTERN.replace(ahead, ""))]
        self.full, self.fast = (x.encode_ordinary for x in made)
        self.double = regex.compile(r"\s\s").search

    def __call__(self, text: str) -> list[int]:
        return self.full(text) if self.double(text) else self.fast(text)


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, most: int = 2048, path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of documents, each ended by id 0.

    Documents of more than `most` ids are cut into pieces of `most`, counted from
    the end, so that the first may be shorter. Null and empty texts are the id 0 alone.
    """
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Tokens(path)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py()), 0], dtype="<u4")
                first = len(ids) % most or min(most, len(ids))
                cuts = [0, *range(first, len(ids) + 1, most)]
                out += [(doc, k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 5, kinds)],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts(docs).mapInArrow(cut, _PIECE)


class BestFit:
    """Places lengths one by one; `place` gives (sequence, offset)."""

    def __init__(self, size: int, most_open: int):
        self.size, self.most_open = size, most_open
        self.bits, self.open, self.count, self.made = 0, defaultdict(deque), 0, 0

    def _take(self, free: int) -> int:
        line = self.open[free]
        number = line.popleft()
        if not line:
            del self.open[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            number, free = self.made, self.size
            self.made += 1
        left = free - length
        if left:
            self.open[left].append(number)
            self.bits |= 1 << left
            self.count += 1
            if self.count > self.most_open:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return number, self.size - free


def pack(docs: DataFrame, size: int = 2048, most_open: int = 2048, per_group: int = 50_000, path: str | None = None) -> DataFrame:
    """Pieces of documents with sequence_id and offset.

    The number of groups follows from the number of pieces; a group's pieces go
    in an order set by a hash of id and piece, so that a task that runs again
    gives the same places. Rows that repeat an id are packed each on their own.
    No documents give no rows.
    """
    cut = stored(pieces(docs, size, path), "pieces")
    groups = max(1, -(-cut.count() // per_group))
    mix = F.xxhash64("doc_id", "piece", "ids_crc32", "length", "start")
    dealt = (cut.withColumn("mix", mix).withColumn("grp", F.pmod("mix", F.lit(groups)).cast("int")).repartition(groups, "grp")
             .sortWithinPartitions("grp", "mix", "doc_id", "piece"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, fit = None, None
        for batch in batches:
            numbers, offsets = [], []
            for g, length in zip(batch.column("grp").to_pylist(), batch.column("length").to_pylist()):
                if g != group:
                    group, fit = g, BestFit(size, most_open)
                number, offset = fit.place(length)
                numbers.append((g << 40) + number)
                offsets.append(offset)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")),
                                              pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())],
                                             names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return dealt.mapInArrow(place, f"{_PIECE}, sequence_id long, offset long")
