"""Corpus pipeline: toxic documents go, one of each group of near duplicates stays, benchmark holders go, personal data is masked, the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns of
`docs`; the last returns the pieces of documents and their places. Null texts
are empty to every decision and stay null. A table without rows passes through
as such. Further columns of `docs` pass through up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from sinogrid.llm import decontaminate, packing, pii, simhash, toxicity
from sinogrid.llm.tables import residue, stored, table

REJECT = 0.7


def without_toxic(spark, docs, sf_dir):
    """Documents that the counterfactual-regularised classifier scores below REJECT."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), residue(3) != 1)
    return docs.where(toxicity.score(docs, model) < REJECT)


def one_of_each_group(spark, docs, sf_dir):
    """One document of each group that a Jaccard similarity of five-word shingles of 0.8 or more links, exactly."""
    return simhash.deduplicated(docs, similarity=0.8)


def without_benchmark(spark, docs, sf_dir):
    """Documents in which no benchmark item is found, under its own or other numbers, names and units."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark, docs, sf_dir):
    """Documents with personal data replaced by its kind; n_chars counts the new text."""
    model = pii.fit(docs)
    out = docs.withColumn("text", pii.redacted(docs, model))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def packed(spark, docs, sf_dir):
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return packing.pack(docs, size=2048)


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", one_of_each_group),
    ("decontamination", without_benchmark),
    ("pii", masked),
    ("packing", packed),
]
#: models and tokens are beyond SQL; the tests hold each stage against a brute-force version
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
