import re
from collections import Counter
from itertools import permutations

import numpy as np

from hyperweave.llm import filteraudit

from .helpers import LONG, ODD, SCHEMA, empty


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = "A" if len(words) < 200 else ""
    out += "B" if 100 * len(set(words)) < 50 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else ""
    return out + ("D" if re.search(r"[#$%&*|]", text) else "")


def brute(docs, labels):
    out = []
    docs = [(i, t or "", lang or "") for i, t, lang in docs]
    failed = [fails(t) + ("E" if i is not None and any(t == u and j is not None and j < i for j, u, _ in docs) else "") for i, t, _ in docs]
    for part in {d[2] for d in docs}:
        own = [(i, f) for (i, _, lang), f in zip(docs, failed) if lang == part]
        rows, share = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            left = own
            for k, f in enumerate(order):
                gone = [(i, x) for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                share[f] += len(gone)
                lost = [sum(max((l[c] == 1 for l in labels if l[0] == i and l[c] is not None), default=False) for i, _ in gone if i is not None) for c in (1, 2)]
                rows.append((part, order, k + 1, len(left), len(gone), sum(f in x for _, x in own) - len(gone), sum(x == f for _, x in own), *lost))
        out += [(*r, share[r[1][r[2] - 1]]) for r in rows]
    return sorted(out)


def test_equals_filters_applied_one_after_the_other(spark):
    many = " ".join(f"w{k}" for k in range(250))
    texts = [many, many + " $", many.upper(), "Short text.", "a b c", LONG, many, many, "A|B", "a b é ü", "", " \x0b\x1f "]
    rows = [(k % 17, t, ("en", "de", None, "")[k % 4]) for k, t in enumerate(texts * 3)] + [(r[0], r[1], r[2]) for r in ODD] + [(None, many, "en")]
    labels = [(k, k % 2, (k // 2) % 2) for k in range(12)] + [(3, None, None), (None, 1, 1), (3, 1, 0), (99, 1, 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, mask string")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filteraudit.audited(df, known)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, labels)


def test_no_documents_no_rows(spark):
    known = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filteraudit.audited(empty(spark), known).collect() == []
    found = filteraudit.audited(spark.createDataFrame(ODD, SCHEMA), known)
    assert {r.part for r in found.collect()} == {"", "en"} and found.count() == 2 * 600


def test_min_plus_product():
    inf = np.inf
    masks = np.array([[0, inf, 0], [inf, inf, inf]])
    positions = np.array([[3.0, 1], [1, 2], [2, 3]])
    assert filteraudit.removal_steps(masks, positions).tolist() == [[2, 1], [inf, inf]]
