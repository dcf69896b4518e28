"""Personal data by patterns and a skip-chain conditional random field.

Patterns give the base spans. The field labels the tokens that could be personal
data (those with a digit or an @; words of letters alone are held at `other`, so
that inference splits at them without error). Neighbouring tokens share a chain
potential, and repeated or similar tokens of a document (equal digits, or equal
letters but for case and punctuation), however far apart, share a skip potential
that favours equal labels; each is tied to its previous occurrence. Loopy
message passing runs over all documents of a batch at once. What the field is
sure of, and no base span touches, is added.

The field learns from the base spans of sampled documents by pseudo-likelihood.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sinogrid.llm.tables import texts

KINDS = ("email", "ip", "card", "phone")
_LABELS = len(KINDS) + 1  # 0: other
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SIGN = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*+[0-9@]\S*")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def _emails(text: str) -> list[tuple[int, int]]:
    """As one pattern would find them, but in linear time: from each @, the run before it and the labels behind it."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        run = text[floor:at]
        start = floor + len(run.rstrip(_LOCAL))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end()))
        floor = found.end() if found else at + 1
        at = text.find("@", floor)
    return out


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(x - 9 if x > 9 else x for x in (2 * int(c) for c in digits[-2::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the patterns, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    if not _SIGN.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, *m.span()))
    return out


def _shape(token: str) -> str:
    """Runs of capitals, letters and digits by one sign each."""
    short = re.sub(r"[0-9]+", "9", token[:64])
    return re.sub(r"[^\W\d_a]+", "a", re.sub(r"[A-Z]+", "A", short))[:16]


@dataclass
class Graph:
    """Candidate tokens of some documents and the edges among them."""

    spans: list[tuple[int, int, int]] = field(default_factory=list)  # document, start, end
    features: list[list[str]] = field(default_factory=list)
    chain: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)

    def add(self, number: int, text: str) -> None:
        first, seen, before = len(self.spans), {}, None
        found = list(_TOKEN.finditer(text)) if _SIGN.search(text) else []
        shapes = [_shape(m.group()) for m in found]
        for k, m in enumerate(found):
            node, token = first + k, m.group()
            digits = _NOT_DIGIT.sub("", token)
            # tokens touch if one white space character lies between them
            left = before is not None and m.start() - before == 1
            right = k + 1 < len(found) and found[k + 1].start() - m.end() == 1
            word = text[max(0, m.start() - 24):m.start()].rsplit(None, 1)[-1:] if not left else []
            self.spans.append((number, m.start(), m.end()))
            self.features.append([
                "bias", f"shape {shapes[k]}", f"digits {min(len(digits), 20)}", f"length {min(len(token), 40) // 4}",
                f"first {_shape(token[0])}", f"last {_shape(token[-1])}", f"at {'@' in token}", f"dots {min(token.count('.'), 4)}",
                f"left {shapes[k - 1] if left else '-'}", f"right {shapes[k + 1] if right else '-'}",
                f"word {word[0].lower()[:12] if word else '-'}" if left or not word else "word"])
            if left:
                self.chain.append((node - 1, node))
            key = digits if len(digits) >= 4 else token.lower().strip(".,;:!?()[]\"'")
            if key in seen:
                self.skip.append((seen[key], node))
            seen[key] = node
            before = m.end()


@dataclass
class Model:
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    chain: np.ndarray = field(default_factory=lambda: np.zeros((_LABELS, _LABELS)))
    skip: float = 0.0


def _labels(graph: Graph, spans: list[list[tuple[int, int, int]]]) -> np.ndarray:
    """Label of each token: the kind of a base span that overlaps it, the first by start."""
    out = np.zeros(len(graph.spans), np.int64)
    at = {n: sorted(((a, b, k) for k, a, b in own)) for n, own in enumerate(spans)}
    place: dict[int, int] = {}
    for i, (n, a, b) in enumerate(graph.spans):
        own, p = at[n], place.get(n, 0)
        while p < len(own) and own[p][1] <= a:
            p += 1
        place[n] = p
        if p < len(own) and own[p][0] < b:
            out[i] = own[p][2] + 1
    return out


def train(docs: list[str], rounds: int = 200, step: float = 0.1, decay: float = 1e-4) -> Model:
    """Pseudo-likelihood: each token's label given its neighbours', their labels being those of the base spans."""
    graph = Graph()
    for n, text in enumerate(docs):
        graph.add(n, text)
    if not graph.spans:
        return Model()
    y = _labels(graph, [base_spans(t) for t in docs])
    names = sorted({f for own in graph.features for f in own})
    index = {f: i for i, f in enumerate(names)}
    nodes = len(y)
    row = np.repeat(np.arange(nodes), [len(f) for f in graph.features])
    col = np.array([index[f] for own in graph.features for f in own])
    one = np.eye(_LABELS)[y]
    chain, skip = (np.array(e, np.int64).reshape(-1, 2) for e in (graph.chain, graph.skip))
    votes = np.zeros((nodes, _LABELS))
    np.add.at(votes, skip[:, 0], one[skip[:, 1]])
    np.add.at(votes, skip[:, 1], one[skip[:, 0]])
    w, t, s = np.zeros((len(names), _LABELS)), np.zeros((_LABELS, _LABELS)), 0.0
    size = w.size + t.size + 1
    m, v = np.zeros(size), np.zeros(size)
    for k in range(1, rounds + 1):
        logits = np.zeros((nodes, _LABELS))
        np.add.at(logits, row, w[col])
        np.add.at(logits, chain[:, 1], t[y[chain[:, 0]]])
        np.add.at(logits, chain[:, 0], t.T[y[chain[:, 1]]])
        logits += s * votes
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        err = (p / p.sum(axis=1, keepdims=True) - one) / nodes
        gw, gt = np.zeros_like(w), np.zeros_like(t)
        np.add.at(gw, col, err[row])
        np.add.at(gt, y[chain[:, 0]], err[chain[:, 1]])
        np.add.at(gt.T, y[chain[:, 1]], err[chain[:, 0]])
        grad = np.concatenate([(gw + decay * w).ravel(), (gt + decay * t).ravel(), [(err * votes).sum() + decay * s]])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = step * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-9)
        w, t, s = w - move[:w.size].reshape(w.shape), t - move[w.size:-1].reshape(t.shape), max(0.0, s - move[-1])
    return Model({f: w[i] for f, i in index.items()}, t, float(s))


def marginals(graph: Graph, model: Model, sweeps: int = 12, damping: float = 0.3) -> np.ndarray:
    """Label chances of each token by loopy sum-product; exact where the edges form no loop that is longer than `sweeps`."""
    nodes = len(graph.spans)
    local = np.zeros((nodes, _LABELS))
    for i, own in enumerate(graph.features):
        for f in own:
            w = model.weights.get(f)
            if w is not None:
                local[i] += w
    edges = np.array([*graph.chain, *graph.skip], np.int64).reshape(-1, 2)
    if len(edges):
        pot = np.concatenate([np.broadcast_to(model.chain, (len(graph.chain), _LABELS, _LABELS)),
                              np.broadcast_to(model.skip * np.eye(_LABELS), (len(graph.skip), _LABELS, _LABELS))])
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pot = np.concatenate([pot, pot.transpose(0, 2, 1)])
        half = len(edges)
        back = np.concatenate([np.arange(half, 2 * half), np.arange(half)])
        message = np.zeros((2 * half, _LABELS))
        for _ in range(sweeps):
            belief = local.copy()
            np.add.at(belief, dst, message)
            out = (belief[src] - message[back])[:, :, None] + pot
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            message = damping * message + (1 - damping) * new
        np.add.at(local, dst, message)
    p = np.exp(local - local.max(axis=1, keepdims=True)) if nodes else local
    return p / p.sum(axis=1, keepdims=True)


def find(docs: list[str], model: Model, sure: float = 0.9) -> list[tuple[list, list]]:
    """(base spans, added spans) of each text, each (kind number, start, end) by kind, then start."""
    graph, base = Graph(), []
    for n, text in enumerate(docs):
        graph.add(n, text)
        base.append(base_spans(text))
    out = [(own, []) for own in base]
    if not model.weights or not graph.spans:
        return out
    chances = marginals(graph, model)
    best = chances.argmax(axis=1)
    taken = _labels(graph, base) > 0
    good = (best > 0) & (chances[np.arange(len(best)), best] >= sure) & ~taken
    joined = {b: a for a, b in graph.chain}
    last: dict[int, int] = {}
    for i in np.nonzero(good)[0].tolist():
        n, a, b = graph.spans[i]
        added = out[n][1]
        if joined.get(i) == last.get(n, -2) and added and added[-1][0] == best[i] - 1:
            added[-1] = (added[-1][0], added[-1][1], b)
        else:
            added.append((int(best[i]) - 1, a, b))
        last[n] = i
    for n, (_, added) in enumerate(out):
        for k, (kind, a, b) in enumerate(added):
            token = docs[n][a:b]
            left = len(token) - len(token.lstrip("\"'([{<,;:"))
            added[k] = (kind, a + left, max(a + left, a + len(token.rstrip("\"')]}>.,;:!?"))))
        added[:] = sorted(x for x in added if x[1] < x[2])
    return out


def fit(docs: DataFrame, sample_rows: int = 4000) -> Model:
    """Fit on about sample_rows of the documents with a digit or an @, chosen by a hash (all, if there are fewer)."""
    rows = texts(docs).where(F.col("text").rlike("[0-9@]"))
    n = rows.count()
    share = min(1.0, sample_rows / max(1, n))

    @F.arrow_udf("string")
    def near(text: pa.Array) -> pa.Array:
        return pa.array([_context(t) for t in text.to_pylist()], pa.string())

    picked = rows.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_000)) < share * 1_000_000)
    return train(sorted(r[0] for r in picked.select(near("text")).collect()))


def _context(text: str) -> str:
    """The candidates of a text and 40 characters round each, for training; gaps between them have no say."""
    out, upto = [], 0
    for m in _TOKEN.finditer(text):
        a, b = max(upto, m.start() - 40), min(len(text), m.end() + 40)
        if a > upto:
            out.append(" ... ")
        if b > a:
            out.append(text[a:b])
            upto = b
    return "".join(out)


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def spans(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end) in code points, end exclusive; null texts are empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    @F.arrow_udf("struct<base: array<struct<kind: string, start: long, end: long>>, added: array<struct<kind: string, start: long, end: long>>>")
    def found(text: pa.Array) -> pa.Array:
        rows = find(text.to_pylist(), shared.value)
        name = lambda own: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in own]
        return pa.array([{"base": name(b), "added": name(a)} for b, a in rows], pa.struct([("base", pa.list_(one)), ("added", pa.list_(one))]))

    return texts(docs).select("doc_id", found("text").alias("s")).select("doc_id", "s.base", "s.added")


def report(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, base counts by kind, digest of the base spans, all spans as text, and how many were added."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = [(f"n_{k}", pa.int64()) for k in KINDS] + [("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64())]

    @F.arrow_udf("struct<n_email: long, n_ip: long, n_card: long, n_phone: long, base_sha256: string, spans: string, n_added: long>")
    def read(text: pa.Array) -> pa.Array:
        rows = []
        for base, added in find(text.to_pylist(), shared.value):
            rows.append((*(sum(k == n for k, _, _ in base) for n in range(len(KINDS))), hashlib.sha256(_written(base).encode()).hexdigest(),
                         _written(sorted(base + added)), len(added)))
        return pa.StructArray.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], [n for n, _ in kinds])

    return texts(docs).select("doc_id", read("text").alias("r")).select("doc_id", "r.*")


def redact(text: str, spans_: list[tuple[int, int, int]]) -> str:
    """Each span by its kind in brackets; overlapping spans by the kind of the one that starts first."""
    out, at = [], 0
    for a, b, k in sorted((a, -b, k) for k, a, b in spans_):
        b = -b
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: Model):
    """Column with the text after redaction; null texts stay null."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def clean(text: pa.Array) -> pa.Array:
        values = text.to_pylist()
        rows = find([t or "" for t in values], shared.value)
        return pa.array([None if t is None else redact(t, base + added) for t, (base, added) in zip(values, rows)], pa.string())

    return clean(F.col("text").cast("string"))
