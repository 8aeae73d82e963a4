import hashlib
import random

import numpy as np

from maskrisk.llm import suffix_dedup as D
from maskrisk.llm.queries import op5_suffix_dedup


def brute(rows):
    """(id, text) to what stays and the number of removed bytes and runs, string by string."""
    texts = [((1 << 62) if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for j in range(len(b) - 49):
            s = b[j : j + 50]
            first[s] = min(first.get(s, i), i)
    out = []
    for i, b in texts:
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = True
        runs = int((gone & ~np.concatenate(([False], gone[:-1]))).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def test_query_against_all_strings(spark, sf, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_suffix_dedup(spark, sf).collect()}
    assert got == {i: (*x[:3], hashlib.sha256(x[3]).hexdigest()) for (i, _), x in zip(rows, brute(rows))}


def test_small_alphabets_and_edges(spark):
    rng = random.Random(5)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randint(45, 120))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 4)))) for i in range(40)]
    rows += [(41, "z" * 49), (42, "z" * 50), (43, "z" * 200), (44, "z" * 49), (45, "é" * 25), (46, "é" * 25)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in D.covered_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: x for (i, _), x in zip(rows, brute(rows))}


def test_odd_rows(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in D.covered_bytes(odd_docs).collect())
    assert got == sorted((str(i), *x) for (i, _), x in zip(rows, brute(rows)))
    assert D.covered_bytes(no_docs).count() == 0
    cut = D.drop_repeats(odd_docs)
    assert cut.columns == odd_docs.columns
    text = {r.doc_id: r.text for r in cut.collect()}
    assert text[3] is None and text[4] == "" and text[1].startswith("the quick") and text[2] == "" and text[9] == " changed"
    assert {r.n_removed for r in cut.collect()} == {"x"} and D.drop_repeats(no_docs).count() == 0


def test_multikey_sort():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 3, (500, 4)).astype(np.uint64)
    order, group = D.multikey(words)
    rows = [tuple(x) for x in words[order].tolist()]
    assert rows == sorted(rows) and [a != b for a, b in zip(rows, rows[1:])] == np.diff(group).astype(bool).tolist()
