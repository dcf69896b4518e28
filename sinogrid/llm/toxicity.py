"""Toxicity classifier with counterfactual regularisation.

A logistic model over the words of a text and their leading letters, each
counted once. For every labelled sentence that names a group of people, copies
with another group's name in its place are built; a labelled text that names
none stands once more with a name put in, and is copied with another name and
with none. Training adds
`penalty` * (score - score of the copy)**2. So the model cannot lean on which
group is named, and neutral mentions are not taken for abuse. How many features
it takes and how strongly weights are held down is chosen by the loss on folds
of the learning rows, so a small sample is not learned by heart.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sinogrid.llm.tables import stored

#: fixed values: words that name groups of people, in sets whose members can stand for each other
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"), ("immigrants", "refugees", "natives"), ("young", "old"), ("deaf", "blind", "disabled"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"), ("muslime", "christen", "juden"),
)
_SWAPS = {w: tuple(x for x in group if x != w) for group in IDENTITY_TERMS for w in group}
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\n]+")
_NAMES = tuple((x, group[(i + 1) % len(group)]) for group in IDENTITY_TERMS for i, x in enumerate(group))
_PREFIXES = (4, 5, 6)
_FOLDS = 4
_SIZES = (0.5, 1, 2, 4)
_DECAYS = (1e-5, 1e-4, 1e-3)
_CACHED = 300_000


def word_features(word: str) -> list[str]:
    return [word, *(f"{word[:k]}*" for k in _PREFIXES if len(word) >= k)]


def features(text: str) -> set[str]:
    return {f for w in set(_WORD.findall(text.lower())) for f in word_features(w)}


def swaps(text: str) -> list[tuple[set[str], set[str]]]:
    """Features of each sentence with a group's name, and of it with each other name instead."""
    out = []
    low = text.lower()
    if not any(w in low for w in _SWAPS):
        return out
    for sentence in _SENTENCE.split(low):
        words = _WORD.findall(sentence)
        named = [w for w in dict.fromkeys(words) if w in _SWAPS]
        if named:
            before = {f for w in words for f in word_features(w)}
            for name in named:
                for other in _SWAPS[name]:
                    out.append((before, {f for w in words for f in word_features(other if w == name else w)}))
    return out


def swapped(text: str) -> list[tuple[list[str], list[str]]]:
    """For each sentence with a group's name and each other name: the features that a swap takes and gives."""
    return [(sorted(before - after), sorted(after - before)) for before, after in swaps(text)]


def frame(text: str) -> tuple[set[str], set[str], set[str]]:
    """Features of a text that names no group, of it with a name put in, and with another of the same set; the text decides which."""
    name, other = _NAMES[zlib.crc32(text.encode("utf-8", "replace")) % len(_NAMES)]
    own = features(text)
    return own, own | set(word_features(name)), own | set(word_features(other))


@dataclass
class Model:
    bias: float = -2.0
    weights: dict[str, float] = field(default_factory=dict)
    pairs: int = 0


def fit(docs: DataFrame, labels: DataFrame, learn_from: Column, sample_rows: int = 9_000, max_features: int = 1024,
        penalty: float = 100.0) -> Model:
    """Fit on labelled documents where `learn_from` holds.

    The sample has about sample_rows / 3 toxic and twice as many other documents
    (all, if there are fewer), chosen by a hash; both kinds weigh the same in
    all. Of the features that tell the classes apart best (chi-squared), the
    model keeps half as many as there are toxic rows, or as many, two or four
    times as many, max_features at most; this and the decay of weights are those
    with the least loss over four folds, each ranked and fitted without its own
    rows. `pairs` of the model is the number of swaps it was held to. Null
    labels and ids are not learned from; a document with several labels is toxic
    if one of them says so. Without rows of both kinds, or if no choice does
    better on the folds than no features, the model is its bias alone.
    """
    marks = (labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").where(learn_from)
             .groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")))
    sizes = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Model(bias=2.0 if sizes.get(1) else -2.0)
    shares = {1: min(1.0, sample_rows / 3 / sizes[1]), 0: min(1.0, sample_rows / 1.5 / sizes[0])}
    share = F.when(F.col("toxic") == 1, shares[1]).otherwise(shares[0])
    # ids are drawn before texts are read: about sample_rows of them, so that they can be sent to all tasks
    drawn_ids = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share * 1_000_000)
    known = (docs.where(learn_from).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
             .join(F.broadcast(drawn_ids), "doc_id"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by = Counter()
            for toxic, fold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                by.update((f, toxic, fold) for f in features(text.as_py()))
            names, toxic, fold = zip(*by) if by else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toxic, pa.int32()), pa.array(fold, pa.int32()),
                                              pa.array(list(by.values()), pa.int64())], names=["feature", "toxic", "fold", "n"])

    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(_FOLDS)).cast("int")
    sample = stored(known.select("toxic", fold.alias("fold"), "text"), "labelled")
    drawn = {(r["toxic"], r["fold"]): r["n"] for r in sample.groupBy("toxic", "fold").agg(F.count("*").alias("n")).collect()}
    rows = [sum(n for (kind, _), n in drawn.items() if kind == k) for k in (0, 1)]
    if not all(rows):
        return Model(bias=float(np.log(sizes[1] / sizes[0])))
    counts = stored(sample.mapInArrow(count, "feature string, toxic int, fold int, n long").groupBy("feature").agg(
        *[F.coalesce(F.sum(F.when((F.col("toxic") == k) & (F.col("fold") == i), F.col("n"))), F.lit(0)).alias(f"n{k}{i}")
          for k in (0, 1) for i in range(_FOLDS)]), "features")

    def best(without: int | None) -> list[str]:
        """The features that tell the classes apart best, in that order, as counted in all folds but one."""
        folds = [i for i in range(_FOLDS) if i != without]
        c, t = (sum(F.col(f"n{k}{i}") for i in folds) for k in (0, 1))
        all_c, all_t = (sum(drawn.get((k, i), 0) for i in folds) for k in (0, 1))
        apart = t / all_t - c / all_c
        both = (t + c) / (all_t + all_c)
        return [r[0] for r in counts.where(t + c >= 5).orderBy(F.desc(apart * apart / (both * (1.001 - both))), "feature")
                .limit(max_features).select("feature").collect()]

    # a fold is of use if both it and the others have rows of both kinds
    folds = [i for i in range(_FOLDS) if all(0 < drawn.get((k, i), 0) < rows[k] for k in (0, 1))]
    ranked = {i: best(i) for i in [*folds, None]}
    named = [f for group in IDENTITY_TERMS for w in group for f in word_features(w)]
    index = {f: i for i, f in enumerate(dict.fromkeys([f for names in ranked.values() for f in names] + named))}

    lists = pa.list_(pa.list_(pa.int32()))
    kind = pa.struct([("own", pa.list_(pa.int32())), ("frame", pa.list_(pa.int32())), ("before", lists), ("after", lists)])

    @F.arrow_udf("struct<own: array<int>, frame: array<int>, before: array<array<int>>, after: array<array<int>>>")
    def read(text: pa.Array) -> pa.Array:
        known = lambda found: sorted(index[f] for f in found if f in index)
        out = []
        for t in text.to_pylist():
            pairs = swaps(t)
            put_in = None if pairs else frame(t)
            pairs = pairs or [put_in[:2], put_in[1:]]
            out.append({"own": known(features(t)), "frame": known(put_in[1]) if put_in else None,
                        "before": [known(a) for a, _ in pairs], "after": [known(b) for _, b in pairs]})
        return pa.array(out, kind)

    own, toxic, part, frames, before, after = [], [], [], [], [], []
    for r in sample.select("toxic", "fold", read("text").alias("r")).select("toxic", "fold", "r.*").toLocalIterator():
        own.append(r["own"])
        toxic.append(r["toxic"])
        part.append(r["fold"])
        frames.append(r["frame"])
        before += r["before"]
        after += r["after"]
    y, part = np.array(toxic, float), np.array(part)

    def heft(y: np.ndarray) -> np.ndarray:
        return np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))

    def held_out(size: int, decay: float) -> float:
        loss = 0.0
        for i in folds:
            column = {index[f]: j for j, f in enumerate(ranked[i][:size])}
            cut = [[column[f] for f in x if f in column] for x in own]
            learn = part != i
            bias, w = train([x for x, k in zip(cut, learn) if k], y[learn], heft(y[learn]), [], [], size, 0.0, decay, rounds=200)
            p = np.array([1 / (1 + np.exp(-np.clip(bias + w[x].sum(), -30, 30))) for x, k in zip(cut, learn) if not k])
            loss -= heft(y[~learn]) @ np.log(np.where(y[~learn] == 1, p, 1 - p))
        return loss

    grid = [(min(max_features, max(8, int(rows[1] * k))), decay) for k in _SIZES for decay in _DECAYS]
    # log(2) a fold is the loss of a model without features: one that is no better has learned nothing that holds elsewhere
    loss, size, decay = min((held_out(*x), *x) for x in sorted(set(grid))) if folds else (np.inf, 0, 0.0)
    if loss >= len(folds) * np.log(2):
        return Model(bias=0.0)
    names = list(dict.fromkeys(ranked[None][:size] + named))
    column = {index[f]: j for j, f in enumerate(names)}
    own, before, after = ([[column[f] for f in x if f in column] for x in lists] for lists in (own, before, after))
    # a text and its frame share the weight of one row
    weight = heft(y) / np.array([1.0 if f is None else 2.0 for f in frames])
    put_in = [i for i, f in enumerate(frames) if f is not None]
    own += [[column[f] for f in frames[i] if f in column] for i in put_in]
    bias, w = train(own, np.append(y, y[put_in]), np.append(weight, weight[put_in]), before, after, len(names), penalty, decay)
    return Model(bias, {f: float(w[j]) for j, f in enumerate(names) if abs(w[j]) > 1e-4}, len(before))


def _matrix(lists: list[list[int]]):
    return np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([i for x in lists for i in x], dtype=np.int64)


def train(own, y, heft, before, after, width: int, penalty: float, decay: float, rounds: int = 800, step: float = 0.05):
    """Weighted logistic loss + decay * |w|**2 + penalty * mean squared change of score from `before` to `after`, by Adam."""
    w, b = np.zeros(width), float(np.log((heft @ y) / max(heft @ (1 - y), 1e-9)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    (row, col), was, now = _matrix(own), _matrix(before), _matrix(after)

    def scores(row: np.ndarray, col: np.ndarray, n: int) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(b + np.bincount(row, w[col], n), -30, 30)))

    for k in range(1, rounds + 1):
        err = heft * (scores(row, col, len(own)) - y)
        grad = np.append(np.bincount(col, err[row], width) + 2 * decay * w, err.sum())
        if before and penalty:
            p, q = scores(*was, len(before)), scores(*now, len(before))
            pull = 2 * penalty / len(before) * (q - p)
            down, up = pull * p * (1 - p), pull * q * (1 - q)
            grad += np.append(np.bincount(now[1], up[now[0]], width) - np.bincount(was[1], down[was[0]], width), (up - down).sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        w, b = w - move[:width], b - move[width]
    return b, w


class Scorer:
    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def __call__(self, text: str) -> float:
        found, seen, weights = set(), self.seen, self.model.weights
        for word in set(_WORD.findall(text.lower())):
            own = seen.get(word)
            if own is None:
                if len(seen) >= _CACHED:
                    seen.clear()
                own = seen[word] = tuple(f for f in word_features(word) if f in weights)
            if own:
                found.update(own)
        total = self.model.bias + sum(weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, total)))))


def score(docs: DataFrame, model: Model) -> Column:
    """Column with the score of `text`, 0 to 1; null and empty texts get the score of no words.

    Texts are read whole, however long. Equal texts and repeated rows are scored
    alike; other columns, whatever their names, are not read. A score of exactly
    the caller's limit is up to the caller: `op4_toxicity` counts it as toxic.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for text in batches:
            yield pa.array([scorer(t) for t in text.to_pylist()], pa.float64())

    return scored(F.coalesce(F.col("text").cast("string"), F.lit("")))
