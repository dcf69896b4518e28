"""Language identification by words first, backing off to ever shorter character n-grams.

The model has, per language, log frequencies of words and of the character
n-grams of words (with a mark at either end). A word it knows is scored by its
word frequency alone. One that it doesn't know is scored by the mean log
frequency of its longest known n-grams: of order 5, or else 4, and so on down to
single letters; a word without any known letter says nothing. A document's
scores are the sums over its words, every occurrence counted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinogrid.llm.tables import stored

UNKNOWN = "und"
_WORD = regex.compile(r"\p{L}+")
_ORDER = 5
_CACHED = 200_000
_CHUNK = 60
_RUN = 1 << 16


@dataclass
class Model:
    """Row numbers of words and n-grams in `scores` (rows x languages)."""

    languages: list[str]
    words: dict[str, int]
    grams: dict[str, int]
    scores: np.ndarray


def fit(docs: DataFrame, learn_from: Column, sample_rows: int = 16_000, max_words: int = 60_000, max_grams: int = 60_000) -> Model:
    """Fit on documents where `learn_from` holds and lang is not null.

    The sample holds about sample_rows / (number of languages) documents of each
    language (all, if it has fewer), chosen by a hash of id and text. The model
    keeps the max_words most frequent words that occur twice or more, and for
    each order the max_grams most frequent n-grams. Without documents to learn
    from the model knows no language.
    """
    known = docs.where(learn_from & F.col("lang").isNotNull()).select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], {}, {}, np.zeros((0, 0), np.float32))
    share = F.create_map(*[x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample_rows / len(languages) / sizes[k])))])
    sample = known.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    words = stored(sample.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).where("word <> ''")
                   .groupBy("lang", "word").agg(F.count("*").alias("n")), "words")

    def frequent(counts: DataFrame, name: str, most: int, least: int) -> list:
        """Most frequent names with their counts by language."""
        row = [F.coalesce(F.sum(F.when(F.col("lang") == k, F.col("n"))), F.lit(0)).alias(f"n{i}") for i, k in enumerate(languages)]
        return (counts.groupBy(name).agg(F.sum("n").alias("n"), *row).where(F.col("n") >= least)
                .orderBy(F.desc("n"), name).limit(most).drop("n").collect())

    # a long run is cut into chunks, each read with the first letters of the next one: no n-gram is lost or met twice
    marked = F.concat(F.lit("<"), "word", F.lit(">"))
    parts = words.select("lang", "n", F.regexp_extract_all(marked, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0)).alias("parts"))
    grams = [parts.select("lang", "n", F.posexplode(F.expr(
        f"transform(parts, (p, i) -> concat(p, substring(coalesce(get(parts, i + 1), ''), 1, {k - 1})))")).alias("at", "w"))
        .where((F.col("at") == 0) | (F.length("w") >= k)).select("lang", "n", F.explode(F.expr(
            f"transform(sequence(1, greatest(length(w) - {k - 1}, 1)), i -> substring(w, i, {k}))")).alias("gram"))
        for k in range(1, _ORDER + 1)]
    names, rows, scores = {}, {}, []
    for name, lists in (("word", [frequent(words, "word", max_words, 2)]), ("gram", [frequent(g, "gram", max_grams, 1) for g in grams])):
        index = {}
        for found in lists:
            if not found:
                continue
            counts = np.array([r[1:] for r in found], dtype=np.float64)
            totals = counts.sum(axis=0, keepdims=True)
            base = sum(map(len, scores))
            index |= {r[0]: base + i for i, r in enumerate(found) if r[0] not in index}
            scores.append(np.log((counts + 0.5) / (totals + 0.5 * len(found))).astype(np.float32))
        names[name] = index
    return Model(languages, names["word"], names["gram"], np.concatenate(scores) if scores else np.zeros((0, len(languages)), np.float32))


class Scorer:
    """Scores texts; remembers a bounded number of unseen words."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}
        self.zero = np.zeros(len(model.languages), np.float32)

    def unseen(self, word: str) -> np.ndarray:
        found = self.seen.get(word)
        if found is None:
            marked, grams = f"<{word}>", self.model.grams
            found = self.zero
            for k in range(_ORDER, 0, -1):
                total, times = 0.0, 0
                for begin in range(0, len(marked) - k + 1, _RUN):
                    rows = [grams[g] for i in range(begin, min(begin + _RUN, len(marked) - k + 1)) if (g := marked[i:i + k]) in grams and g not in "<>"]
                    if rows:
                        total, times = total + self.model.scores[rows].sum(axis=0, dtype=np.float64), times + len(rows)
                if times:
                    found = (total / times).astype(np.float32)
                    break
            if len(word) > _CHUNK:
                return found
            if len(self.seen) >= _CACHED:
                self.seen.clear()
            self.seen[word] = found
        return found

    def __call__(self, text: str | None) -> tuple[str, float]:
        counts = Counter(_WORD.findall(text.lower())) if text else None
        if not counts or not self.model.languages:
            return UNKNOWN, 0.0
        known, times, total = [], [], self.zero.astype(np.float64)
        get = self.model.words.get
        for word, n in counts.items():
            row = get(word)
            if row is None:
                total = total + n * self.unseen(word)
            else:
                known.append(row)
                times.append(n)
        if known:
            total = total + np.asarray(times, np.float64) @ self.model.scores[known]
        chances = np.exp(total - total.max())
        best = int(chances.argmax())
        return self.model.languages[best], float(chances[best] / chances.sum())


def predict(docs: DataFrame, model: Model, keep: list[Column]) -> DataFrame:
    """`keep` of each document with lang_pred and score (posterior of equally likely languages).

    Null texts and texts without a letter (number signs such as a half or a
    circled one are none) are `und` with score 0. Runs of letters are read whole. Ties, as of a
    text whose letters are all unknown, go to the first language by name.
    Repeated rows are scored alike; further columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for text in batches:
            found = [scorer(t) for t in text.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                             ["lang_pred", "score"])

    return docs.select(*keep, scored(F.col("text").cast("string")).alias("s")).select("*", "s.lang_pred", "s.score").drop("s")


