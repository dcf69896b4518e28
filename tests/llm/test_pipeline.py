"""Stages of the pipeline on a small corpus, each held against what it must do."""

import corpus_pipeline
from tests.llm import helpers as h


def test_stages(spark, data, tmp_path):
    item = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    docs = [(i, h.words(i, 60), "en", "s", 1) for i in range(40)]
    docs += [(100, docs[3][1], "en", "s", 1), (101, docs[4][1] + " more", "en", "s", 1), (102, f"{h.words(900, 40)} {item} {h.words(901, 40)}", "en", "s", 1),
             (103, f"{h.words(902, 40)} mail x.y@example.com", "en", "s", 1), (104, None, None, None, None), (105, "", "en", "s", 0),
             (106, h.words(903, 40) + " idiot scum trash loser pathetic worthless moron", "en", "s", 1)]
    table = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "decontamination", "pii", "packing"]
    ids = lambda df: {x.doc_id for x in df.collect()}

    kept = stages["toxicity"](spark, table, data)
    assert kept.columns == table.columns and ids(kept) >= set(range(40)) | {100, 104, 105}
    kept = stages["simhash"](spark, table, data)
    assert kept.columns == table.columns and ids(kept) == set(range(40)) | {102, 103, 104, 106}
    kept = stages["decontamination"](spark, table, data)
    assert kept.columns == table.columns and ids(kept) == {d[0] for d in docs} - {102}
    masked = {x.doc_id: x for x in stages["pii"](spark, table, data).collect()}
    assert masked[103].text.endswith("mail [EMAIL]") and masked[103].n_chars == len(masked[103].text)
    assert masked[0].text == docs[0][1] and masked[104].text is None
    assert ids(stages["packing"](spark, table, data)) == {d[0] for d in docs}
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, table.limit(0), data).count() == 0
