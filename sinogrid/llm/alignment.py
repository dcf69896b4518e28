"""Alignment of two tokenisations of the same bytes by sparse incidence matrices.

A and B are the incidence matrices of tokens (rows) and bytes (columns). The
product A x B' holds how many bytes a pair of tokens shares: the overlap links.
Offsets where tokens of both sides end cut the bytes into groups. With the
incidence of ids and groups on each side, the product over groups holds how
often two ids are linked by a group: the shared-group links. An Arrow batch of
documents is one block-diagonal matrix, so a product is a few array operations.

How many documents hold a pair of ids is counted over the corpus. The most
frequent pairs, `common` of them, are a broadcast table of that size at most;
the counts of all other pairs reach their documents by joins.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinogrid.llm.csr import Csr
from sinogrid.llm.packing import Tokens, tokenizer_path
from sinogrid.llm.tables import discarded, kept, texts

#: a pair of ids is one number, A's id times this plus B's
SIDE = 1 << 31


def piece_path(name: str = "piece_bpe_32k") -> str:
    import public_tokenizers

    return public_tokenizers.path(f"{name}.model")


def byte_side(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """Encoder of texts, each after a space, by a byte-level vocabulary, and its tokens' bytes by id."""
    import base64

    with open(path, "rb") as file:
        ranks = {int(b): base64.b64decode(a) for a, b in map(bytes.split, file)}
    encode = Tokens(path)
    return lambda rows: [encode(" " + t) for t in rows], [ranks.get(k, b"") for k in range(max(ranks) + 1)]


def piece_side(path: str) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """Encoder of texts by a piece vocabulary, which puts a space first itself, and its pieces' bytes by id."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    named = [model.id_to_piece(k) for k in range(model.get_piece_size())]
    held = [bytes([int(p[3:5], 16)]) if model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(named)]
    return lambda rows: model.encode(rows, num_threads=1), held


class Batch:
    """Two tokenisations of some documents, one after the other in one line of bytes."""

    def __init__(self, ids: tuple[list, list], held: tuple[list[bytes], list[bytes]], texts: list[str]):
        joined = [[b"".join(map(h.__getitem__, own)) for own in side] for side, h in zip(ids, held)]
        ok = [bool(t) and a == b == b" " + t.encode() for t, a, b in zip(texts, *joined)]
        self.count = len(texts)
        self.ids, self.docs, self.ends = [], [], []
        for side, h in zip(ids, held):
            own = [x if good else () for x, good in zip(side, ok)]
            sizes = np.fromiter(map(len, h), np.int64, len(h))
            lengths = np.fromiter(map(len, own), np.int64, len(own))
            line = np.fromiter(chain.from_iterable(own), np.int64, lengths.sum())
            self.ids.append(line)
            self.docs.append(np.repeat(np.arange(len(own)), lengths))
            self.ends.append(np.cumsum(sizes[line]))
        self.bytes = int(self.ends[0][-1]) if len(self.ends[0]) else 0
        both = np.zeros((2, self.bytes + 1), np.bool_)
        for side, e in zip(both, self.ends):
            side[e] = True
        cut = both[0] & both[1]
        self.cuts = np.flatnonzero(cut)
        before = np.cumsum(cut) - cut
        self.groups = [before[e] for e in self.ends]

    def counted(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(values, minlength=self.count)

    def token_bytes(self, side: int) -> Csr:
        starts = np.concatenate([[0], self.ends[side]])
        return Csr(starts, np.arange(self.bytes), np.ones(self.bytes, np.int64), self.bytes)

    def overlaps(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(A token, B token, shared bytes) of tokens that share bytes, tokens numbered through the batch."""
        for first, part in self.token_bytes(0).products(self.token_bytes(1).transposed()):
            yield part.rows() + first, part.columns, part.values

    def group_links(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(document, pair of ids, occurrences) of ids whose tokens share a group."""
        names, sides = [], []
        for ids, docs, groups in zip(self.ids, self.docs, self.groups):
            keys, row = np.unique(docs * SIDE + ids, return_inverse=True)
            names.append(keys)
            sides.append(Csr.of(row, groups, len(keys), len(self.cuts)))
        for first, part in sides[0].products(sides[1].transposed()):
            a = names[0][part.rows() + first]
            yield a // SIDE, a % SIDE * SIDE + names[1][part.columns] % SIDE, part.values

    def written(self, tables: tuple[list[str], list[str]]) -> list[str]:
        """The groups of each document as text: ids of a group's A side, a bar, those of its B side, groups parted by semicolons."""
        sizes = [np.bincount(g, minlength=len(self.cuts)) for g in self.groups]
        # where each token of a side comes: behind its own side's and the other's tokens of earlier groups
        earlier = np.cumsum(sizes[1]) - sizes[1], np.cumsum(sizes[0])
        at = [np.arange(len(g)) + e[g] for g, e in zip(self.groups, earlier)]
        codes, docs = (np.empty(len(self.ids[0]) + len(self.ids[1]), np.int64) for _ in range(2))
        for k, (place, g) in enumerate(zip(at, self.groups)):
            last = np.append(np.diff(g) != 0, True)[:len(g)]
            codes[place] = self.ids[k] * 2 + last + k * len(tables[0])
            docs[place] = self.docs[k]
        both = tables[0] + tables[1]
        parts = list(map(both.__getitem__, codes.tolist()))
        at = np.searchsorted(docs, np.arange(self.count + 1)).tolist()
        return ["".join(parts[a:b])[:-1] for a, b in zip(at, at[1:])]


def _marks(count: int, end: str) -> list[str]:
    """For each id its number with a comma, then with the end of its side."""
    return [f"{k}{mark}" for k in range(count) for mark in (",", end)]


_ALIGNED = "doc_id long, mark long, n_a long, n_b long, n_groups long, n_links long, n_overlaps long, groups_sha256 string, pairs array<bigint>, times array<int>"


def _parts(rows: list[tuple], most: int) -> Iterator[list[tuple]]:
    """Rows in turn, as many as have `most` characters together."""
    held, size = [], 0
    for row in rows:
        if held and size + len(row[-1]) > most:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row[-1])
    if held:
        yield held


def aligned(docs: DataFrame, byte_path: str | None = None, pieces: str | None = None, at_once: int = 1 << 20) -> DataFrame:
    """One row per document: numbers of tokens, groups, links and overlaps, a digest of the groups, and the linked pairs of ids with their occurrences.

    Documents that are null or empty, or whose tokens do not give their bytes
    back, have no tokens. `mark` is a hash of the text. Texts are taken in parts
    of `at_once` characters, or one text.
    """
    byte_path, pieces = byte_path or tokenizer_path(), pieces or piece_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides = byte_side(byte_path), piece_side(pieces)
        held = tuple(h for _, h in sides)
        tables = _marks(len(held[0]), "|"), _marks(len(held[1]), ";")
        for batch in batches:
            for part in _parts(list(zip(*(c.to_pylist() for c in batch.columns))), at_once):
                rows = [t for _, _, t in part]
                yield _row_batch(part, Batch(tuple(encode(rows) for encode, _ in sides), held, rows), tables)

    named = texts(docs).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    return named.mapInArrow(run, _ALIGNED)


def _row_batch(part: list[tuple], made: Batch, tables) -> pa.RecordBatch:
    links = list(made.group_links())
    doc, pair, times = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k in range(3))
    shared = np.zeros(made.count, np.int64)
    for a, _, _ in made.overlaps():
        shared += made.counted(made.docs[0][a])
    digests = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in made.written(tables)]
    n_links = np.bincount(doc, weights=times, minlength=made.count).astype(np.int64)
    n_groups = made.counted(made.docs[0][np.searchsorted(made.ends[0], made.cuts)])
    bounds = pa.array(np.searchsorted(doc, np.arange(made.count + 1)).astype(np.int32))
    columns = [pa.array([i for i, _, _ in part], pa.int64()), pa.array([m for _, m, _ in part], pa.int64()),
               *(pa.array(x, pa.int64()) for x in (made.counted(made.docs[0]), made.counted(made.docs[1]), n_groups, n_links, shared)),
               pa.array(digests, pa.string()), pa.ListArray.from_arrays(bounds, pa.array(pair, pa.int64())),
               pa.ListArray.from_arrays(bounds, pa.array(times.astype(np.int32), pa.int32()))]
    return pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in _ALIGNED.split(", ")])


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, best): in how many documents a pair of ids is linked, and whether no pair of its A id is in more."""
    counts = kept(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    a = F.shiftright("pair", 31).alias("a")
    most = counts.groupBy(a).agg(F.max("n").alias("most"))
    out = kept(counts.select("*", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    discarded(counts)
    return out


def link_report(docs: DataFrame, common: int = 1 << 18, **settings) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_overlaps) of each document.

    n_best counts the links whose pair of ids no other pair of the same A id
    exceeds in documents, count_sum adds up the documents of the links' pairs.
    Repeated rows are documents of their own. Null ids stay null. No documents
    give no rows; further columns are left out.
    """
    rows = kept(aligned(docs, **settings), "aligned")
    counts = pair_counts(rows)
    top = counts.orderBy(F.desc("n"), "pair").limit(common).toArrow()
    order = np.argsort(top["pair"].to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(top[c].to_numpy(zero_copy_only=False)[order] for c in ("pair", "n", "best")))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        keys, n, best = np.append(keys, np.int64(2**63 - 1)), np.append(n, 0), np.append(best, False)
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            bounds = pairs.offsets.to_numpy().astype(np.int64)
            doc = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            pair, time = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.searchsorted(keys, pair)
            known = keys[at] == pair
            whole = lambda x: pa.array(_summed(doc, np.where(known, x, 0), batch.num_rows), pa.int64())
            left = np.concatenate([[0], np.cumsum(~known)])[bounds - bounds[0]].astype(np.int32)
            rest = pa.ListArray.from_arrays(pa.array(left), pa.StructArray.from_arrays(
                [pa.array(pair[~known], pa.int64()), pa.array(time[~known], pa.int64())], ["pair", "times"]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _KEPT), whole(time * best[at]), whole(time * n[at]), rest],
                                             names=[*_KEPT, "n_best", "count_sum", "rest"])

    found = rows.mapInArrow(looked_up, _LOOKED)
    out = found.drop("rest")
    if top.num_rows == common:
        # rows that are alike have the same rest; one of each is looked up
        found = kept(found, "looked-up")
        rest = found.select("doc_id", "mark", F.explode("rest").alias("r")).select("doc_id", "mark", "r.pair", "r.times").distinct()
        times = F.col("times")
        rest = rest.join(counts, "pair").groupBy(F.col("doc_id").alias("rest_id"), F.col("mark").alias("rest_mark")).agg(
            F.sum(F.when(F.col("best"), times).otherwise(0)).alias("more_best"), F.sum(times * F.col("n")).alias("more_sum"))
        more = lambda c: F.coalesce(c, F.lit(0))
        out = found.drop("rest").join(rest, F.col("doc_id").eqNullSafe(F.col("rest_id")) & (F.col("mark") == F.col("rest_mark")), "left").select(
            *_KEPT, (F.col("n_best") + more("more_best")).alias("n_best"), (F.col("count_sum") + more("more_sum")).alias("count_sum"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "n_overlaps")


_KEPT = [f.split()[0] for f in _ALIGNED.split(", ")[:-2]]
_LOOKED = ", ".join(_ALIGNED.split(", ")[:-2]) + ", n_best long, count_sum long, rest array<struct<pair: bigint, times: bigint>>"


def _summed(owner: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    """Sums of whole numbers by owner; owners rise."""
    sums = np.concatenate([[0], np.cumsum(values)])
    at = np.searchsorted(owner, np.arange(count + 1))
    return sums[at[1:]] - sums[at[:-1]]
