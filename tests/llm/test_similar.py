"""Near copies against the exact similarity of all pairs."""

import random

import numpy as np
import pytest

from maskrisk.llm import simhash as S


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def exact(rows, share=0.8):
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            if b < a and len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]) - 1e-12 and up[a] != up[b]:
                low, high = sorted((up[a], up[b]))
                up = {k: low if v == high else v for k, v in up.items()}
    return up


def fixture():
    """Pairs between 0.70 and 0.90: a stretch of new words at the end takes as many shingles away."""
    rng, rows = random.Random(5), []
    words = [f"w{i}" for i in range(5000)]
    for k in range(120):
        n, cut = 300, 17 + k // 3
        text = [rng.choice(words) for _ in range(n)]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(text[: n - cut] + [rng.choice(words) for _ in range(cut)]))]
    return rows


@pytest.mark.parametrize("block", [S.BLOCK, 2])
def test_against_all_pairs(spark, block):
    rows = fixture()
    want = exact(rows)
    got = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()}
    copies = {i for i in want if want[i] < i}
    found = {i for i in got if got[i] < i}
    assert 30 < len(copies) < 90 and found <= copies and len(found) >= 0.96 * len(copies)


def test_sets_against_all_pairs():
    rng = random.Random(6)
    rows = []
    for k in range(6):
        base = [rng.choice("abcdefghij") + str(rng.randrange(40)) for _ in range(80)]
        for j in range(12):
            rows.append((len(rows), " ".join(w if rng.random() > 0.003 * j else "new" + str(rng.random()) for w in base)))
    rows.append((len(rows), ""))
    up = {i: i for i, _ in rows}
    for i, j in S.alike([np.unique(S.shingle_hashes(t, 5)) for _, t in rows], 0.8):
        low, high = sorted((up[i], up[j]))
        up = {k: low if v == high else v for k, v in up.items()}
    assert up == exact(rows) and len(set(up.values())) < len(rows) - 10


def test_dropped_documents_have_a_similar_one(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = exact(rows)
    got = {r.doc_id: r.component_id for r in S.similar_groups(docs).collect()}
    assert got == want


def test_different_texts_of_one_doc_id_are_judged_each(spark):
    words = [f"w{i}" for i in range(400)]
    one, two, three = " ".join(words[:120]), " ".join(words[120:260]), " ".join(words[260:])
    rows = [(1, one, "a"), (1, two, "b"), (1, two, "b"), (2, one + " more", "c"), (3, two + " more", "d"), (4, three, "e"), (4, three + " more", "f"), (None, one, "g")]
    got = sorted((r.doc_id or 0, r.text, r._hash) for r in S.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string, _hash string")).collect())
    assert [x for x in got if x[0] != 4] == sorted([(0, one, "g"), (1, one, "a"), (1, two, "b")])
    assert len([x for x in got if x[0] == 4]) == 1
