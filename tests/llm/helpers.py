"""Documents that hold every odd case, and plain versions of the operators to compare with."""

import hashlib
import random
import re

import xxhash

WORDS = "stone river green light paper house under seven often music table north grain cloud sharp quiet early wheel coast broad".split()


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice("abcdefghij") for _ in range(n))


def odd_documents():
    """(doc_id, text) with nulls, empty and long texts, copies, near copies and repeated rows."""
    long = words(1, 30_000)
    return [
        (1, words(2, 80)), (2, words(2, 80)), (3, words(2, 79) + " other"), (4, None), (5, ""), (6, " \n\t "), (7, long), (8, long),
        (9, "one"), (10, "one two"), (11, words(3, 40) + "\n" + words(2, 80)), (12, "Ünïcödé 漢字 " + words(4, 30)), (13, "x" * 5000),
        (14, "a@b.co a@b.co +1 (555) 010-2030 and 10.0.0.1"), (15, words(2, 80)), (None, words(2, 80)), (None, "nobody"), (16, "last"), (16, "last"),
    ]


SCHEMA = "doc_id long, text string"


def documents(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def with_clashes(df):
    """The same rows with further columns, named as columns and temporary names of the operators."""
    from pyspark.sql import functions as F

    out = df
    for name in ("node", "fp", "block", "component_id", "id", "tie", "data", "kept_id", "row", "bad_id", "item", "g", "piece", "grp", "mix", "copy", "score", "s", "r"):
        out = out.withColumn(name, F.lit("clash"))
    return out


def fingerprint(text, k=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(found[i:i + k]), 42) for i in range(max(1, len(found) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(names, linked):
    """Smallest name of each one's group."""
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in names}


def without_repeats(rows, length):
    """(n_bytes, n_removed, n_spans, sha256) by id and text."""
    seen, out = set(), {}
    for doc_id, tie, text in sorted({(i if i is not None else -(2**63), x, t or "") for i, t, x in rows}):
        data = text.encode()
        gone = bytearray(len(data))
        for p in range(len(data) - length + 1):
            window = data[p:p + length]
            if window in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(window)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[None if doc_id == -(2**63) else doc_id, text] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out
