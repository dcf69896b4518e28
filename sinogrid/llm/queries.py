"""The operators as queries over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from sinogrid.llm import alignment, decontaminate, filters, langid, multiset, packing, pii, ring, setsketch, simhash, suffix, toxicity, warc
from sinogrid.llm.tables import residue, table

_REGISTRY = {}


def query(fn):
    _REGISTRY[fn.__name__] = fn
    return fn


def all_queries() -> dict:
    return dict(_REGISTRY)


@query
def op8_ring_shards(spark, d):
    """Law `rows`: every shard takes its exact share. Null ids form one key, a null text has 8 bytes and CRC 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = table(spark, d, "documents").select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    out = ring.assign(rows, "doc_id", ["doc_id", "text_crc32", "size"], shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
                      "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op1_simhash(spark, d):
    docs = table(spark, d, "documents")
    found = simhash.near_duplicates(docs, words=3, bits=64, parts=4, agree=2, distance=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")


@query
def op4_toxicity(spark, d):
    """Null ids are never learned from and not held out."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, d, "labels"), residue(3) != 1)
    scored = docs.select("doc_id", F.coalesce(residue(3) == 1, F.lit(False)).alias("held_out"), toxicity.score(docs, model).alias("score"))
    return scored.select("*", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_language(spark, d):
    """Null ids are never learned from and not held out."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs, residue(4) != 2)
    return langid.predict(docs.select("doc_id", "text"), model,
                          [F.col("doc_id"), F.coalesce(residue(4) == 2, F.lit(False)).alias("held_out")])


@query
def op5_multiset_hash(spark, d):
    return multiset.edited_likeness(table(spark, d, "documents"))


@query
def op7_best_fit_packing(spark, d):
    return packing.pack(table(spark, d, "documents"), size=2048)


@query
def op6_template_decontamination(spark, d):
    return decontaminate.matches(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op3_skip_chain_pii(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pii.report(docs, pii.fit(docs))


@query
def op2_warc_derivatives(spark, d):
    return warc.derive(warc.responses(table(spark, d, "pages")))


@query
def op9_suffix_dedup(spark, d):
    return suffix.without_repeats(table(spark, d, "documents"), length=100).drop("kept")


@query
def op13_filter_audit(spark, d):
    return filters.audit(table(spark, d, "documents"), table(spark, d, "labels"))


@query
def op12_token_alignment(spark, d):
    return alignment.link_report(table(spark, d, "documents"))


@query
def op11_setsketch(spark, d):
    return setsketch.near_duplicates(table(spark, d, "documents"))
