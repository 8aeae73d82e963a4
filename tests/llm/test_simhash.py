import random
import re

import numpy as np
import xxhash

from maskrisk.llm import simhash as S
from maskrisk.llm.queries import op1_simhash


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(ids, fps, bits=4):
    up = list(range(len(ids)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                up[top(i)] = top(j)
    out = {}
    for i, d in enumerate(ids):
        out.setdefault(top(i), []).append(d)
    return {d: min(g) for g in out.values() for d in g}


def test_query_against_all_pairs(spark, sf, docs):
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: brute(r.text) for r in rows}
    got = op1_simhash(spark, sf).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {k: f"{v:016x}" for k, v in fps.items()}
    assert {r.doc_id: r.component_id for r in got} == components(list(fps), list(fps.values()))


def test_spanning_joins_what_all_pairs_join():
    rng = random.Random(1)
    for _ in range(20):
        base = [rng.getrandbits(64) for _ in range(3)]
        fps = list({rng.choice(base) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(60)})
        up = list(range(len(fps)))
        for i, j in S.spanning(np.array(fps, np.uint64)[:, None], 4):
            a, b = up[i], up[j]
            up = [min(a, b) if x in (a, b) else x for x in up]
        groups = {}
        for i, g in enumerate(up):
            groups.setdefault(g, set()).add(i)
        want = components(list(range(len(fps))), fps)
        assert {frozenset(g) for g in groups.values()} == {frozenset(k for k, v in want.items() if v == g) for g in set(want.values())}


def test_no_pair_within_four_bits_is_missed(spark):
    rng = random.Random(2)
    rows = []
    for k in range(40):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << i for i in rng.sample(range(64), 4))
        rows += [(2 * k, a - (a >> 63 << 64)), (2 * k + 1, b - (b >> 63 << 64))]
    links = S.near_links(spark.createDataFrame(rows, "node long, f0 long"), 1, 3, 4, 4).collect()
    assert {frozenset((r.a, r.b)) for r in links} >= {frozenset((2 * k, 2 * k + 1)) for k in range(40)}


def test_odd_rows(odd_docs, no_docs):
    got = S.near_groups(odd_docs).collect()
    assert len(got) == 12
    by = {r.doc_id: r for r in got}
    assert by[3].fingerprint == by[4].fingerprint == by[5].fingerprint == "0" * 16 and by[5].component_id == 3 and by[2].component_id == 1
    assert S.near_groups(no_docs).count() == 0
    kept = S.drop_near_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(2) == 0 and ids.count(1) == 1 and ids.count(None) == 1 and ids.count(3) == 1 and 4 not in ids
    assert S.drop_near_copies(no_docs).count() == 0


def test_near_copies_of_four_fifths(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(30):
        text = [rng.choice(words) for _ in range(400)]
        copy = list(text)
        for i in rng.sample(range(400), 6):
            copy[i] = "changed"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(copy))]
    got = {r.doc_id: r.component_id for r in S.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), **S.SIMILAR).collect()}
    caught = sum(got[2 * k + 1] == 2 * k for k in range(30))
    assert caught >= 27 and len(set(got.values())) == 60 - caught
