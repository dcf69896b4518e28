"""The filter audit against a plain simulation of every order, on odd documents."""

import re
from collections import Counter
from itertools import permutations

from sinogrid.llm import filters
from tests.llm import helpers as h

ROWS = [(1, "a b c " * 100, "en"), (2, "a b c " * 100, None), (3, None, None), (4, "", "en"), (5, "ABC def", "en"), (6, h.words(1, 250), "de"),
        (6, h.words(1, 250), "de"), (6, h.words(2, 250) + " $", "de"), (7, h.words(1, 250), ""), (None, "nobody", "en"), (None, "nobody", "en"),
        (8, "nobody", "en"), (9, h.words(3, 20_000), "fr"), (10, h.words(4, 220) + " A" * 90, "fr")]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (6, 1, 1), (7, 1, 0), (99, 1, 1), (None, 1, 1), (8, None, 1)]


def fails(rows):
    low = -(2**63)
    first = {}
    for i, t, _ in rows:
        first[t or ""] = min(first.get(t or "", 2**63), low if i is None else i)
    out = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t),
               "D": bool(re.search(r"[#$%&*|]", t)), "E": (low if i is None else i) > first[t]}
        good, toxic = (any(x[0] == i and x[k] == 1 for x in LABELS if i is not None) for k in (1, 2))
        out.append((lang or "", {k for k, v in own.items() if v}, good, toxic))
    return out


def plain(rows):
    held, out, share = fails(rows), [], Counter()
    parts = {p for p, *_ in held}
    for order in permutations("ABCDE"):
        for part in parts:
            left = [x for x in held if x[0] == part]
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                own = [x for x in held if x[0] == part and f in x[1]]
                left = [x for x in left if f not in x[1]]
                share[part, f] += len(gone)
                out.append([part, "".join(order), step, len(left), len(gone), len(own) - len(gone), sum(x[1] == {f} for x in own),
                            sum(x[2] for x in gone), sum(x[3] for x in gone)])
    return sorted(tuple(x) + (share[x[0], x[1][x[2] - 1]],) for x in out)


def test_audit_equals_simulation(spark):
    docs = h.with_clashes(spark.createDataFrame(ROWS, "doc_id long, text string, lang string"))
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    assert sorted(tuple(r) for r in filters.audit(docs, labels).collect()) == plain(ROWS)


def test_no_documents_and_no_labels(spark):
    docs = spark.createDataFrame(ROWS[:5], "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filters.audit(docs.limit(0), none).collect() == []
    assert {r.good_lost + r.toxic_lost for r in filters.audit(docs, none).collect()} == {0}
