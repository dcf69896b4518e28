"""Token alignment against loops over bytes, on odd texts and by whole query."""

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from sinogrid.llm import alignment, queries
from sinogrid.llm.csr import Csr
from tests.llm import helpers as h


def byte_alphabet():
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {**{chr(b): b for b in keep}, **{chr(256 + n): b for n, b in enumerate(rest)}}


@pytest.fixture(scope="module")
def sides():
    import public_tokenizers

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    letters = byte_alphabet()
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def of_a(text):
        ids = a.encode(" " + text, add_special_tokens=False).ids
        return [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]

    def of_b(text):
        named = [(i, b.id_to_piece(i)) for i in b.encode(text)]
        return [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in named]

    return of_a, of_b


def plain(rows, sides):
    """The report by loops: (doc_id, text) -> columns."""
    docs = []
    for _, text in rows:
        a, b = (side(text) for side in sides) if text else ([], [])
        if not text or not b"".join(x for _, x in a) == b"".join(x for _, x in b) == b" " + text.encode():
            docs.append(([], []))
            continue
        ends = []
        for side in (a, b):
            at, own = 0, []
            for _, held in side:
                at += len(held)
                own.append(at)
            ends.append(own)
        cuts = sorted(set(ends[0]) & set(ends[1]))
        groups = [([], []) for _ in cuts]
        for k, side in enumerate((a, b)):
            for (i, _), end in zip(side, ends[k]):
                groups[next(g for g, c in enumerate(cuts) if end <= c)][k].append(i)
        docs.append((groups, [(x, y) for ga, gb in groups for x in ga for y in gb]))
    count = Counter(p for _, links in docs for p in set(links))
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for (doc_id, _), (groups, links) in zip(rows, docs):
        told = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links),
                    sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links), hashlib.sha256(told.encode()).hexdigest() if told else ""))
    return sorted(out, key=repr)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


ODD = [(30, "<|endoftext|> and </s><unk> <0x41>"), (31, "two  spaces\tand\nlines ▁ x"), (32, "café 日本語 \U0001f600 ال"), (33, "▁"), (34, " lead"),
       (35, "ﬁ ligature ½"), (36, "\x00zero"), (37, "a b▁c")]


@pytest.mark.parametrize("common", [1 << 18, 16, 1])
def test_report_equals_loops(spark, sides, common):
    rows = [(i, t if t is None or len(t) < 6000 else t[:6000]) for i, t in h.odd_documents()] + ODD
    out = alignment.link_report(h.with_clashes(h.documents(spark, rows)), common=common)
    assert got(out) == plain(rows, sides)


def test_small_parts_change_nothing(spark, sides):
    rows = [r for r in h.odd_documents() if r[1] is None or len(r[1]) < 6000] + ODD
    assert got(alignment.link_report(h.documents(spark, rows), at_once=50)) == plain(rows, sides)


def test_no_documents(spark):
    assert alignment.link_report(h.documents(spark, [])).collect() == []


def test_query(spark, data, sides):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.all_queries()["op12_token_alignment"](spark, data)
    assert got(found) == plain(rows, sides)
    assert found.where("n_groups > 0").count() > 0.5 * len(rows)


def test_products_of_matrices():
    r = np.random.default_rng(3)
    a, b = r.integers(0, 3, (17, 40)), r.integers(-1, 2, (40, 23))
    sparse = lambda m: Csr.of(*np.nonzero(m), *m.shape, m[np.nonzero(m)])
    for at_once in (1, 60, 1 << 20):
        out = np.zeros((17, 23), int)
        for first, part in sparse(a).products(sparse(b), at_once):
            out[part.rows() + first, part.columns] += part.values
        assert (out == a @ b).all()
    again = sparse(a).transposed()
    assert (again.height, again.width) == (40, 17) and (np.add.at(m := np.zeros((40, 17), int), (again.rows(), again.columns), again.values) or (m == a.T).all())


def test_overlaps_count_shared_bytes():
    batch = alignment.Batch(([[0, 1], [2]], [[0], [1]]), ([b" a", b"bc", b" d"], [b" abc", b" d"]), ["abc", "d"])
    found = sorted(zip(*(np.concatenate(x).tolist() for x in zip(*batch.overlaps()))))
    assert found == [(0, 0, 2), (1, 0, 2), (2, 1, 2)]
