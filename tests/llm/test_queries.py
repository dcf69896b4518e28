"""The registered queries over a whole small folder against plain versions, or by held-out accuracy."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from sinogrid.llm import oracles, packing, queries
from tests.compare import check, connect
from tests.llm import helpers as h
from tests.llm.test_text import plain_spans

ALL = queries.all_queries()


@pytest.fixture(scope="module")
def texts(spark, data):
    return dict(spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())


@pytest.mark.parametrize("name", sorted(oracles.all_oracles()))
def test_query_equals_sql(spark, data, name):
    assert check(ALL[name](spark, data), connect(data), oracles.all_oracles()[name]) is None


def test_simhash_query(spark, data, texts):
    own = {i: h.fingerprint(t) for i, t in texts.items()}
    ids = sorted(texts)
    want = h.groups(ids, [(a, b) for a in ids for b in ids if b < a and (own[a] ^ own[b]).bit_count() <= 2])
    got = ALL["op1_simhash"](spark, data).collect()
    assert {x.doc_id: (x.fingerprint, x.component_id) for x in got} == {i: (f"{own[i]:016x}", want[i]) for i in ids}


def test_pii_query(spark, data, texts):
    got = {x.doc_id: x for x in ALL["op3_skip_chain_pii"](spark, data).collect()}
    assert set(got) == set(texts)
    for i, t in texts.items():
        spans = [f"{('email', 'ip', 'card', 'phone')[k]}:{a}:{b}" for k, a, b in plain_spans(t)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest() and set(spans) <= set(got[i].spans.split(","))


def test_multiset_query(spark, data, texts):
    order = sorted(texts, reverse=True)
    got = {x.doc_id: x for x in ALL["op5_multiset_hash"](spark, data).collect()}
    for i, after in zip(order, order[1:] + order[:1]):
        t, half = texts[i], len(texts[i]) // 2
        edited = t[:len(t) - half] + texts[after][:half]
        assert (got[i].n_chars, got[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert sum(x.near_edited > x.near_next for x in got.values()) > 0.9 * len(got)


def test_packing_query(spark, data, texts):
    encode = packing.Tokens(packing.tokenizer_path())
    tokens, filled = {}, {}
    for x in ALL["op7_best_fit_packing"](spark, data).collect():
        tokens.setdefault(x.doc_id, []).append(x)
        filled.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert set(tokens) == set(texts)
    total = 0
    for i, parts in tokens.items():
        ids = packing.np.array([*encode(texts[i]), 0], dtype="<u4")
        parts = sorted(parts, key=lambda x: x.piece)
        assert [x.start for x in parts] + [len(ids)] == [0, *(x.start + x.length for x in parts)]
        assert all(zlib.crc32(ids[x.start:x.start + x.length]) == x.ids_crc32 for x in parts)
        total += len(ids)
    for line in filled.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(line), sorted(line)[1:])) and sum(n for _, n in line) <= 2048
    assert len(filled) <= 1.06 * total / 2048 + 1


def test_repeats_query(spark, data, texts):
    want = h.without_repeats([(i, t, 0) for i, t in texts.items()], 100)
    got = ALL["op9_suffix_dedup"](spark, data).collect()
    assert {(x.doc_id, texts[x.doc_id]): (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in got} == want


def test_decontamination_query(spark, data, texts):
    items = spark.read.parquet(f"{data}/benchmark.parquet").collect()
    got = {(x.doc_id, x.item_id) for x in ALL["op6_template_decontamination"](spark, data).collect()}
    assert got == {(i, x.item_id) for i, t in texts.items() for x in items if x.text in t}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = ALL["op10_language"](spark, folder).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.97 * found.count()
    marks = ALL["op4_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    rows = marks.groupBy("toxic").agg(F.avg("score").alias("s")).collect()
    means = {int(x.toxic): x.s for x in rows}
    assert means[1] > means[0] + 0.3


def test_warc_text_is_worked_out_once(spark):
    from sinogrid.llm import warc

    pages = spark.createDataFrame([(1, "u", "<p>a  b &#65;&amp;<!-- x --></p>\n\n<script>y</script> c \t d")], "page_id BIGINT, url STRING, html STRING")
    out = warc.derive(warc.responses(pages))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("</template") == 1
    assert out.where("record_type = 'conversion'").first().content == "a b A&\nc d"
