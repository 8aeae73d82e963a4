import random
import re
from collections import Counter

import numpy as np
import pytest

from maskrisk.llm import collocations as C
from maskrisk.llm.queries import op11_collocations
from maskrisk.llm.sql import OP11
from tests.test_against_sql import rows as compared

FIELDS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def plain(rows, threshold, longest=5, top=2000):
    """The contract, word by word, in one process: rows are (lang, text)."""
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            words = re.findall("[^ \t]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {x for x, c in f.items() if c >= threshold and len(x[1]) > 1}
    covered = {(lang, w[i : i + m]) for lang, w in candidates for m in range(2, len(w)) for i in range(len(w) - m + 1) if f[lang, w] >= f[lang, w[i : i + m]]}
    out = []
    for lang in n:
        mine = []
        for w in (w for x, w in candidates - covered if x == lang):
            a = f[lang, w]
            score, k = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w)))
            mine.append((score, a, " ".join(w), f[lang, w[:k]], f[lang, w[k:]]))
        mine.sort(key=lambda x: (-x[0], -x[1], x[2].encode()))
        out += [(lang, i, p, a, left, right, n[lang], s) for i, (s, a, p, left, right) in enumerate(mine[:top], 1)]
    return sorted(out)


def made(df):
    return sorted(tuple(r[c] for c in FIELDS) for r in df.collect())


def test_query_against_sql(spark, sf, duck):
    got, want = op11_collocations(spark, sf), duck.sql(OP11)
    assert compared(got.columns, [tuple(r) for r in got.collect()]) == compared(want.columns, want.fetchall())


@pytest.mark.parametrize("threshold, blocks", [(12, 1 << 25), (12, 4000), (3, 30_000)])
def test_documents_against_plain(spark, docs, monkeypatch, threshold, blocks):
    monkeypatch.setattr(C, "BLOCK_BYTES", blocks)
    monkeypatch.setattr(C, "DEAL_MASS", 20_000)
    assert made(C.collocations(docs, threshold)) == plain([(r.lang, r.text) for r in docs.collect()], threshold)


def test_odd_texts(spark, odd_docs, no_docs):
    rng, words = random.Random(2), ["a", "B", "é", "É", "x\x00y", "it's", "\x1c", "ß", "日本", "A"]
    rows = [(None if i % 7 == 0 else rng.choice(["und", "en", ""]), None if i % 9 == 0 else "".join(rng.choice(words) + rng.choice([" ", " ", "\t", "  ", ".", "\x0b", "\r\n", "?!"]) for _ in range(rng.choice([0, 1, 60])))) for i in range(200)]
    df = spark.createDataFrame([(i, *r, 1, "n") for i, r in enumerate(rows)], "doc_id long, lang string, text string, n long, phrase string").repartition(3)
    assert made(C.collocations(df, 5)) == plain(rows, 5)
    assert made(C.collocations(df, 5, top=3)) == plain(rows, 5, top=3)
    assert made(C.collocations(odd_docs, 4)) == plain([(r.lang, r.text) for r in odd_docs.collect()], 4)
    assert C.collocations(no_docs).count() == 0


def test_summaries_lose_no_frequent_hash():
    rng = np.random.default_rng(3)
    for _ in range(30):
        batches = [np.unique(rng.zipf(1.4, 500).astype(np.uint64) % np.uint64(900), return_counts=True) for _ in range(12)]
        true = Counter()
        for keys, counts in batches:
            true.update(dict(zip(keys.tolist(), counts.tolist())))
        summary = C.Summary(sum(true.values()) // 40 + 1)
        for keys, counts in batches:
            summary.merge(keys, counts)
            assert len(summary.keys) <= summary.capacity
        assert summary.lost < 40
        assert {k for k, c in true.items() if c >= 40} <= set(summary.may_reach(40).tolist())


def test_hashes_pack_and_return():
    x = np.sort(np.random.default_rng(1).integers(0, 2**64, 1000, np.uint64))
    assert (C.from_planes(C.planes(x), 1000) == x).all() and not len(C.from_planes(C.planes(x[:0]), 0))


def test_scores_beyond_64_bits(spark):
    a, n, f = 4 * 10**15, 9 * 10**16, 5 * 10**15
    phrases = spark.createDataFrame([("en", "a b", 2, a), ("en", "a", 1, f), ("en", "b", 1, f)], "lang string, phrase string, length int, f long")
    got = C.best_phrases(phrases, spark.createDataFrame([("en", n)], "lang string, n long"), 10, 100).first()
    assert got.score == 1000 * a * n // (f * f) and (got.l, got.r) == (f, f)
