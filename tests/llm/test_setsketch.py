"""SetSketch near-duplicates against all pairs, and the parts of the method."""

import random

import numpy as np
import pytest

from sinogrid.llm import queries, setsketch
from tests.llm import helpers as h


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain(rows, share=85):
    """(doc_id, n, component, kept) by comparison of all pairs that have a shingle in common."""
    low = -(2**63)
    sets = [(i if i is not None else low, shingles(t)) for i, t in rows]
    kinds = {}
    for i, s in sets:
        kinds.setdefault(s, set()).add(i)
    lists = [(s, min(ids)) for s, ids in kinds.items() if s]
    linked = [(min(ids), i) for s, ids in kinds.items() if s for i in ids]
    for k, (s, a) in enumerate(lists):
        for t, b in lists[:k]:
            both = len(s & t)
            if both and 100 * both >= share * (len(s) + len(t) - both):
                linked.append((a, b))
    group = h.groups({i for i, _ in sets}, linked)
    out = [(None if i == low else i, len(s), None if group[i] == low else group[i], group[i] == i) for i, s in sets]
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def edited(r, text, changes):
    w = text.split()
    for _ in range(changes):
        w[r.randrange(len(w))] = r.choice(h.WORDS)
    return " ".join(w)


def family(start, n, size, changes, seed):
    r = random.Random(seed)
    base = h.words(seed, size)
    return [(start + k, edited(r, base, r.randrange(changes + 1))) for k in range(n)]


def test_odd_documents(spark):
    rows = h.odd_documents()
    assert got(setsketch.near_duplicates(h.with_clashes(h.documents(spark, rows)))) == plain(rows)


def test_no_documents(spark):
    assert setsketch.near_duplicates(h.documents(spark, [])).collect() == []


@pytest.mark.parametrize("pivots", [3, 1])
def test_families_around_the_limit(spark, pivots):
    """Copies at all similarities near 0.85, and texts that share a passage."""
    rows = family(0, 60, 200, 9, 1) + family(100, 40, 60, 3, 2) + family(200, 30, 400, 14, 3)
    passage = h.words(9, 150)
    rows += [(300 + k, h.words(1000 + k, 20) + " " + passage + " " + h.words(2000 + k, 20)) for k in range(60)]
    out = setsketch.near_duplicates(h.documents(spark, rows), pivots=pivots)
    assert got(out) == plain(rows)


def test_query(spark, data):
    rows = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.all_queries()["op11_setsketch"](spark, data)) == plain(rows)


def elements(seed, n):
    return np.random.default_rng(seed).integers(0, 2**63, n, np.uint64)


def test_registers_merge():
    a, b = elements(1, 300), elements(2, 9000)
    both = setsketch.registers(np.concatenate([a, b]))
    assert (setsketch.merged(setsketch.registers(a), setsketch.registers(b)) == both).all()
    assert not setsketch.registers(a[:0]).any()


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85, 0.95])
def test_estimates_find_the_similarity(share):
    found, agreed, lost = [], [], []
    for k in range(60):
        n, m = 1000, 700
        common = round(share * (n + m) / (1 + share)) if share < m / n else round(2 * n * share / (1 + share))
        m = m if share < m / n else n
        x = elements(k, n + m - common)
        a, b = (setsketch.registers(s)[None] for s in (x[:n], x[n - common:]))
        e, gap = setsketch.estimated(a, b, np.array([float(n)]), np.array([float(m)]), 0.85)
        found.append(e[0])
        lost.append(gap[0])
        agreed.append((a == b).mean())
    assert abs(np.mean(found) - share) < 0.01 and np.std(found) < 0.04
    assert np.mean(agreed) > share - 0.01
    if share != 0.6:
        assert max(lost) < setsketch.RULED_OUT if share >= 0.85 else min(lost) > setsketch.RULED_OUT


def test_copies_beyond_the_limit_do_not_meet_a_family(spark, monkeypatch):
    """Texts too far from a large family of near copies, though alike to all of it: few pairs go to the full sets."""
    r = random.Random(31)
    base = h.words(30, 200)
    rows = [(k, edited(r, base, r.randrange(4))) for k in range(80)] + [(100 + k, edited(r, base, 9 + k % 6)) for k in range(40)]
    compared, whole = [], setsketch.alike_pairs

    def counted(pairs, *more):
        compared.append(pairs.count())
        return whole(pairs, *more)

    monkeypatch.setattr(setsketch, "alike_pairs", counted)
    assert got(setsketch.near_duplicates(h.documents(spark, rows))) == plain(rows)
    assert sum(compared) < 6 * len(rows)


def test_pivots_list_few_pairs(spark):
    """n texts with a common passage, alike to none: the pairs judged grow with n, not with its square."""
    counts = []
    for n in (60, 120):
        passage = h.words(5, 300)
        rows = [(k, passage + " " + h.words(3000 + k, 150)) for k in range(n)]
        docs = h.documents(spark, rows)
        nodes = setsketch.sketches(docs).withColumnRenamed("doc_id", "node")
        listed = setsketch._buckets(nodes)
        counts.append(setsketch._pivoted(listed, 3).count() / n)
        assert setsketch._rare(docs.withColumnRenamed("doc_id", "node"), 5, 0.85).groupBy("shingle").count().where("count > 3").isEmpty()
    assert counts[1] < 1.6 * counts[0] + 1
