import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from sinogrid.llm import multiset, packing, ring, simhash, suffix, tables
from sinogrid.llm.components import components
from tests.llm import helpers as h


def test_components_against_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(300 + i, 301 + i) for i in range(40)]
    got = {x.node: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = h.groups({x for e in edges for x in e}, edges)
    assert got == {n: want[n] for e in edges if e[0] != e[1] for n in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_of_odd_documents(spark):
    rows = h.odd_documents()
    df = h.with_clashes(h.documents(spark, rows))
    got = simhash.near_duplicates(df, words=3, bits=64, parts=4, agree=2, distance=2).collect()
    assert len(got) == len(rows)
    prints = {x.doc_id: x.fp[0] % 2**64 for x in got if x.doc_id is not None}
    assert prints == {i: h.fingerprint(t) for i, t in rows if i is not None}
    ids = [i if i is not None else -1 for i, _ in rows]
    own = [h.fingerprint(t) for _, t in rows]
    links = [(ids[a], ids[b]) for a in range(len(ids)) for b in range(a) if (own[a] ^ own[b]).bit_count() <= 2]
    want = h.groups(ids, links)
    for x in got:
        if x.doc_id is not None:
            assert (x.component_id if x.component_id is not None else -1) == want[x.doc_id]
    assert simhash.near_duplicates(h.documents(spark, []), words=3, bits=64, parts=4, agree=2, distance=2).count() == 0


def test_simhash_large_blocks_lose_no_link(spark):
    r = random.Random(7)
    base = r.getrandbits(64)
    marks = sorted({base ^ sum(1 << b for b in r.sample(range(20), r.randrange(4))) for _ in range(300)})
    signed = [m - 2**64 if m >= 2**63 else m for m in marks]
    nodes = spark.createDataFrame([(i, [v]) for i, v in enumerate(signed)], "node long, fp array<bigint>")
    pairs = [(a, b) for a in range(len(marks)) for b in range(a) if (marks[a] ^ marks[b]).bit_count() <= 2]
    want = h.groups(range(len(marks)), pairs)
    for small in (2, 1000):
        found = simhash.links(nodes, 64, 4, 2, 2, small=small)
        assert all((marks[x.a] ^ marks[x.b]).bit_count() <= 2 for x in found.collect())
        group = {x.node: x.component for x in components(found).collect()}
        assert {n: group.get(n, n) for n in want} == want


def test_wide_fingerprints_with_pivots_equal_all_pairs(spark):
    r = random.Random(8)
    near = []
    for family in range(6):
        text = h.words(100 + family, 120).split()
        for k in range(30):
            copy = list(text)
            for _ in range(r.randrange(4)):
                copy[r.randrange(len(copy))] = f"edit{r.randrange(1000)}"
            near.append((family * 100 + k, " ".join(copy)))
    df = h.documents(spark, near)
    few = {x.doc_id: x.component_id for x in simhash.near_duplicates(df).collect()}
    assert all(few[i] // 100 == i // 100 for i in few)
    marks = {i: np.array(simhash.fingerprint_words(t.encode(), 5, 2304)).view(np.uint64) for i, t in near}
    parts = {i: np.packbits(np.unpackbits(m.view(np.uint8), bitorder="little").reshape(96, 24), axis=1) for i, m in marks.items()}
    close = [(a, b) for a in marks for b in marks if b < a and int(np.bitwise_count(marks[a] ^ marks[b]).sum()) <= 349
             and (parts[a] == parts[b]).all(axis=1).any()]
    assert few == h.groups(list(marks), close)
    kept = simhash.deduplicated(df)
    assert {x.doc_id for x in kept.collect()} == set(few.values())


def test_alike_finds_every_pair_at_the_limit(spark):
    """Lone pairs at 0.8 and just above, a family with pivots, short texts; all pairs compared, no condition on blocks."""
    r = random.Random(11)
    rows = []
    for k in range(60):  # 4 shingles of n go: n / (n + 4) and more
        text = h.words(1000 + k, 20 + k % 8).split()
        rows += [(10 * k, " ".join(text)), (10 * k + 1, " ".join(text + h.words(2000 + k, r.choice((3, 4, 5))).split()))]
    for k in range(40):
        text = h.words(50, 120).split()
        for _ in range(r.randrange(5)):
            text[r.randrange(120)] = f"edit{r.randrange(1000)}"
        rows.append((5000 + k, " ".join(text)))
    passage = h.words(60, 30)
    rows += [(6000 + k, f"{h.words(3000 + k, 30)} {passage}") for k in range(30)]
    rows += [(7000 + i, t) for i, t in h.odd_documents() if i is not None] + [(None, "nobody")]
    ids = [-1 if i is None else i for i, _ in rows]
    own = [set(simhash.shingle_set((t or "").encode(), 5).tolist()) for _, t in rows]
    close = [(ids[a], ids[b]) for a in range(len(rows)) for b in range(a) if 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])]
    exact = sum(5 * len(own[a] & own[b]) == 4 * len(own[a] | own[b]) for a in range(len(rows)) for b in range(a) if own[a])
    assert exact >= 3
    df = h.with_clashes(h.documents(spark, rows))
    got = simhash.alike(df).collect()
    assert len(got) == len(rows)
    want = h.groups(set(ids), close)
    assert {-1 if x.doc_id is None else x.doc_id: -1 if x.component_id is None else x.component_id for x in got} == want
    stage = dict(corpus_pipeline.STAGES)["simhash"]
    assert {-1 if x.doc_id is None else x.doc_id for x in stage(spark, df, None).collect()} == set(want.values())
    assert simhash.alike(h.documents(spark, [])).count() == 0


def test_texts_beyond_the_limit_meet_few_of_a_family(spark):
    """Texts that have most of a large family's shingles, but too few of them behind their own: only those near enough meet it."""
    r = random.Random(31)
    base, share = h.words(30, 200).split(), Fraction(4, 5)

    def copy(changes):
        text = list(base)
        for at in r.sample(range(5, 195), changes):
            text[at] = f"edit{r.randrange(10**9)}"
        return " ".join(text)

    rows = [(k, copy(r.randrange(4))) for k in range(80)] + [(100 + k, copy(4 + 3 * (k % 8 > 0))) for k in range(40)]
    own = {i: set(simhash.shingle_set(t.encode(), 5).tolist()) for i, t in rows}
    nodes = tables.kept(simhash._described(h.documents(spark, rows), 5, share, 2304).withColumnRenamed("doc_id", "node"), "nodes")
    got = simhash._prefix_pairs(nodes, spark.createDataFrame([(0, k) for k in range(1, 80)], "a long, b long"), share)
    pairs = [frozenset((x.child, x.parent)) for x in got.collect()]
    alike = {frozenset((a, b)) for a in range(100, 140) for b in own if b < a and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b])}
    assert alike and alike <= set(pairs) and len(pairs) == len(set(pairs)) < 1000


def test_deduplicated_keeps_columns_and_one_row(spark):
    df = h.with_clashes(h.documents(spark, h.odd_documents()))
    got = simhash.deduplicated(df)
    assert got.columns == df.columns
    ids = [x.doc_id for x in got.collect()]
    assert len(ids) == len(set(ids)) and 16 in ids and 2 not in ids and 8 not in ids
    assert simhash.deduplicated(h.documents(spark, [])).count() == 0


def test_suffix_array_against_sorting():
    r = random.Random(3)
    for _ in range(500):
        t = [r.randint(1, r.choice([1, 2, 5])) for _ in range(r.randint(0, 50))] + [0]
        assert suffix.suffix_array(np.array(t)).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_repeats_of_odd_documents(spark):
    passage = h.words(9, 30)
    rows = h.odd_documents() + [(100 + i, f"{h.words(200 + i, 20)} {passage} {h.words(300 + i, 20)}") for i in range(30)]
    rows = [(i, t) for i, t in rows if t is None or len(t) < 20_000]
    df = h.documents(spark, rows)
    ties = {x.text: x.tie for x in df.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")).collect()}
    want = h.without_repeats([(i, t, ties[t or ""]) for i, t in rows], 100)
    expected = sorted((repr(i), *want[i, t or ""]) for i, t in rows)
    for most in (1, 2048):
        got = suffix.without_repeats(h.with_clashes(df), most=most).collect()
        assert sorted((repr(x.doc_id), x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got) == expected
    assert suffix.without_repeats(h.documents(spark, [])).count() == 0


def test_repeats_leave_their_ranges_alone(spark, monkeypatch):
    """What goes on disk beside the shuffle of the texts: the runs found, no contexts."""
    from sinogrid import scratch

    made = []

    def noted(df, name):
        made.append((name, tables.kept(df, name)))
        return made[-1][1]

    monkeypatch.setattr(suffix, "kept", noted)
    passage = h.words(9, 30)
    rows = [(i, 0, f"{h.words(200 + i, 20)} {passage} {h.words(300 + i, 20)}".encode()) for i in range(8)]
    found = suffix.repeated(spark.createDataFrame(rows, "id long, tie long, data binary"))
    assert {name for name, df in made if scratch.exists(spark, df.stored_at)} == {"copies", "ranges"}
    assert {x.id for x in found.collect()} == set(range(1, 8))


def test_comparison_has_one_python_node_in_a_stage(spark, monkeypatch):
    """Few pairs were broadcast, so that the scan of the texts and the comparison ran two workers in each task."""
    from sinogrid.llm import pairing

    seen = []
    monkeypatch.setattr(pairing, "kept", lambda df, name: seen.append(df) or tables.kept(df, name))
    texts = [h.words(1, 40), h.words(1, 40) + " more", h.words(2, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    pairs = tables.kept(spark.createDataFrame([(1, 0), (2, 0)], "child long, parent long"), "pairs")
    assert [(r.a, r.b) for r in pairing.alike_pairs(pairs, docs, 5, 0.8).collect()] == [(1, 0)]
    plan = seen[0]._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_bitmaps_of_a_pair_are_compared_once(spark):
    """A filter on their distance went below its column, which each task then computed twice, in two workers."""
    sets = [np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for n in (100, 101, 300)]
    nodes = spark.createDataFrame([(k, len(x), bytearray(simhash.parity_bits(x))) for k, x in enumerate(sets)], "node long, n int, odd binary")
    pairs = spark.createDataFrame([(1, 0), (2, 0)], "child long, parent long")
    got = simhash._plausible(pairs, nodes, Fraction("0.8"), 64, None)
    assert [(r.child, r.parent) for r in got.collect()] == [(1, 0)]
    plan = got._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_anchors_spread_over_their_bitmap(spark):
    """Anchors are the smallest hashes around: places by their leading bits met in a part of the bitmap."""
    found = np.unique(suffix.anchors(np.random.default_rng(5).bytes(1 << 21), 100, 32)[0])
    assert len(found) > 50_000
    assert len(np.unique(suffix._slot(found))) > 0.995 * len(found)
    some = found[:500]
    packed = suffix._bitmap(spark.createDataFrame([(int(x),) for x in some.view(np.int64)], "g long"), "g")
    assert suffix._has(np.frombuffer(packed, np.uint8), some).all()


def test_anchor_chunks_join(monkeypatch):
    data = (h.words(4, 600) + "z" * 700).encode()
    whole = suffix.anchors(data, 100, 32)
    monkeypatch.setattr(suffix, "_CHUNK", 333)
    assert all((a == b).all() for a, b in zip(whole, suffix.anchors(data, 100, 32)))


def test_multiset_hash_is_homomorphic():
    a, b = h.words(1, 50), h.words(2, 60)
    both = multiset.fingerprint(a + "\n" + b)
    assert both.text() == multiset.fingerprint(b + "\n" + a).text() == (multiset.fingerprint(a) + multiset.fingerprint(b)).text()
    assert (both - multiset.fingerprint(b)).text() == multiset.fingerprint(a).text()
    grown = multiset.fingerprint(a)
    grown.add(b.encode())
    assert grown.text() == both.text() and multiset.parse(both.text()).text() == both.text()
    grown.add(a.encode(), -1)
    assert grown.text() == multiset.fingerprint(b).text()
    assert both.text() != multiset.fingerprint(a + "\n" + b + "\n" + b).text()
    assert 0.5 < both.likeness(multiset.fingerprint(a)) < 0.9 and multiset.fingerprint(a).likeness(multiset.fingerprint(b)) < 0.3


def test_edited_texts_of_odd_documents(spark):
    import hashlib

    rows = h.odd_documents()
    order = sorted(((-(2**63) if i is None else i, t or "") for i, t in rows), key=lambda x: (-x[0], x[1]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want.append((repr(None if i == -(2**63) else i), len(t), hashlib.sha256((t[:len(t) - half] + after[:half]).encode()).hexdigest()))
    for per_block in (3, 8192):
        got = multiset.edited_likeness(h.with_clashes(h.documents(spark, rows)), per_block=per_block).collect()
        assert sorted((repr(x.doc_id), x.n_chars, x.edited_sha256) for x in got) == sorted(want)
        assert all(0 <= x.near_edited <= 1 and 0 <= x.near_next <= 1 for x in got)
        same = {x.doc_id: x.fingerprint for x in got}
        assert same[1] == same[2] == same[15] != same[3]
    assert multiset.edited_likeness(h.documents(spark, [])).count() == 0


def test_packing_round_trip(spark):
    import zlib

    rows = h.odd_documents()
    got = packing.pack(h.with_clashes(h.documents(spark, rows)), size=64, most_open=8, per_group=100).collect()
    encode = packing.Tokens(packing.tokenizer_path())
    pieces = []
    for i, t in rows:
        ids = np.array([*encode(t or ""), 0], dtype="<u4")
        first = len(ids) % 64 or min(64, len(ids))
        cuts = [0, *range(first, len(ids) + 1, 64)]
        pieces += [(repr(i), k, a, b - a, zlib.crc32(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted((repr(x.doc_id), x.piece, x.start, x.length, x.ids_crc32) for x in got) == sorted(pieces)
    places = {}
    for x in got:
        places.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for line in places.values():
        at = 0
        for offset, length in sorted(line):
            assert offset == at
            at += length
        assert at <= 64
    assert len(places) <= 1.1 * sum(p[3] for p in pieces) / 64 + 3
    assert packing.pack(h.documents(spark, [])).count() == 0


def test_tokens_equal_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    encode = packing.Tokens(packing.tokenizer_path())
    r = random.Random(2)
    texts = ["", " ", "a  b", "a \n b\n\n c ", "<|endoftext|> it's 12 ½ Ünï 漢", *("".join(r.choice(" \n\ta1.é'　") for _ in range(40)) for _ in range(300))]
    assert all(encode(x) == t.encode(x, add_special_tokens=False).ids for x in texts)


def test_best_fit_takes_the_fullest_and_closes_the_fullest():
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (7, 6, 4, 3)] == [(0, 0), (1, 0), (1, 6), (0, 7)]
    fit = packing.BestFit(10, 2)
    assert [fit.place(n) for n in (7, 8, 6, 2, 3, 4)] == [(0, 0), (1, 0), (2, 0), (0, 7), (2, 6), (3, 0)] or fit.made == 4


def test_ring_balance_and_movement(spark):
    rows = h.with_clashes(spark.range(1000).withColumnRenamed("id", "doc_id")).drop("id")
    got = ring.assign(rows, "doc_id", ["doc_id"], shards=7).collect()
    slots = {}
    for x in got:
        slots.setdefault(x.shard, []).append(x.slot)
    assert len(got) == 1000 and sorted(map(len, slots.values())) == [142] * 1 + [143] * 6
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    loose = {x.doc_id: x.shard for x in ring.assign(rows, "doc_id", ["doc_id"], shards=7, load=1.25).collect()}
    sizes = [list(loose.values()).count(k) for k in range(7)]
    assert max(sizes) <= -(-1000 * 1.25 // 7)
    grown = {x.doc_id: x.shard for x in ring.assign(rows, "doc_id", ["doc_id"], shards=8, load=1.25).collect()}
    assert sum(loose[k] != grown[k] for k in loose) < 350


def test_ring_odd_rows(spark):
    rows = h.documents(spark, [(i, t) for i, t in h.odd_documents()] + [(5, "same")] * 60)
    got = ring.assign(rows, "doc_id", ["doc_id", "text"], shards=24).collect()
    sizes = [sum(x.shard == k for x in got) for k in range(24)]
    assert len(got) == 79 and max(sizes) - min(sizes) <= 1
    assert ring.assign(h.documents(spark, []), "doc_id", ["doc_id"], shards=24).count() == 0


def test_parity_bitmaps_never_rule_out_a_pair():
    r = np.random.default_rng(4)
    for n, m, both in ((1, 1, 0), (5, 70, 3), (64, 65, 64), (400, 300, 250), (3000, 900, 10), (200, 200, 200)):
        x = r.integers(0, 2**64, n + m - both, np.uint64)
        a, b = x[:n], x[n - both:]
        got = simhash.parity_distance(simhash.parity_bits(a), simhash.parity_bits(b))
        assert got == simhash.parity_distance(simhash.parity_bits(b), simhash.parity_bits(a))
        assert got <= n + m - 2 * both and (n + m - 2 * both - got) % 2 == 0
    far = [r.integers(0, 2**64, 400, np.uint64) for _ in range(2)]
    assert simhash.parity_distance(*map(simhash.parity_bits, far)) * 9 > 800


def test_a_shared_passage_makes_no_square_of_pairs(spark):
    passage = h.words(70, 30)
    share, none = simhash.Fraction("0.8"), spark.createDataFrame([], "a long, b long")
    rows = [(k, f"{h.words(4000 + k, 60)} {passage}") for k in range(200)]
    nodes = simhash._described(h.documents(spark, rows), 5, share, 2304).withColumnRenamed("doc_id", "node").cache()
    assert simhash._block_pairs(nodes, 2304, 96).count() <= 200
    assert simhash._prefix_pairs(nodes, none, share).count() <= 200
    nodes.unpersist()


def test_late_places_are_those_that_are_no_firsts(spark):
    places = spark.createDataFrame([(1, 0, [5, 0, 40], [4, 4, 4]), (2, 0, [0, 7], [3, 1]), (3, 0, [1], [5])], "id long, tie long, lo array<int>, more array<int>")
    firsts = spark.createDataFrame([(10, 11, (1, 0, 40)), (12, 13, (2, 0, 0)), (14, 15, (2, 0, 7))], "g long, c long, f struct<id: long, tie: long, lo: int>")
    assert sorted(map(tuple, suffix._late_runs(places, firsts).collect())) == [(1, 0, 0, 9), (3, 0, 1, 6)]


def test_batches_of_texts_are_bounded_in_bytes(spark, tmp_path):
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 4000).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get(setting)

    def rows(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"])

    try:
        spark.conf.unset(setting)
        found = [r["n"] for r in tables.table(spark, str(tmp_path), "documents").mapInArrow(rows, "n long").collect()]
        assert sum(found) > 16_000_000 and max(found) < 5_000_000
        spark.conf.set(setting, "64k")
        tables.small_batches(spark)
        assert spark.conf.get(setting).removesuffix("b") in ("64k", "65536")
    finally:
        spark.conf.set(setting, before)
