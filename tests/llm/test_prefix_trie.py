import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from maskrisk.llm import prefix_trie as P
from maskrisk.llm.queries import op12_prefix_trie
from maskrisk.llm.sql import OP12
from tests.test_against_sql import rows as compared

SCHEMA = "conv_id long, turn long, role string, text string, depth string, key string, pid string"
FIELDS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def plain(rows):
    """The contract, word by word, in one process."""
    own = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), hashlib.sha256(f"{(role or '').encode().hex().upper()}:{text or ''}".encode()).hexdigest(), role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = {c: own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6] + v[zlib.crc32(str(c).encode()) % 6 :] for c, v in own.items()}
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)

    def under(k):
        leaves, saved = (0, 0) if children[k] else (1, 0)
        for x in children[k]:
            a, b = under(x)
            leaves, saved = leaves + a, saved + b
        return leaves, saved + ((len(members[k]) - 1) * len(k[-1][1]) if k else 0)

    out = []
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(built[c]) == len(k))))
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(children[k]), *under(k), hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made(df):
    return sorted((tuple(r[c] for c in FIELDS) for r in P.prefix_trie(df).collect()), key=str)


def test_query_against_plain_and_sql(spark, sf, duck):
    got = op12_prefix_trie(spark, sf)
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r[c] for c in FIELDS) for r in got.collect()), key=str) == plain(rows)
    want = duck.sql(OP12)
    assert compared(got.columns, [tuple(r) for r in got.collect()]) == compared(want.columns, want.fetchall())


@pytest.mark.parametrize("seed", range(3))
def test_shared_prefixes_over_many_ranges(spark, seed, monkeypatch):
    monkeypatch.setattr(P, "RANGE_TURNS", 40)
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(0, 900), 150):
        if rng.random() < 0.3:  # copies of one conversation
            rows += [(c, t, "user", "same" * t) for t in range(5)]
        else:
            rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bb", "é", "", None])) for t in range(rng.choice([0, 1, 2, 4, 9, 40]))]
    rows = [(*r, "x", "y", "z") for r in rows]
    assert made(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_odd_rows(spark):
    assert made(spark.createDataFrame([], SCHEMA)) == []
    rows = [(1, None, None, None), (1, None, None, None), (1, 3, "r", "x" * 100_000), (1, 3, "r", "x"), (None, 1, "r", "lost"), (100, 0, "u", ""), (101, 0, "u", ""), (101, -1, "u", "z"), (102, 0, "u", "é😀"), (7, 0, "ab", "c"), (8, 0, "a", "bc")]
    rows = [(*r, "x", "y", "z") for r in rows]
    assert made(spark.createDataFrame(rows, SCHEMA)) == plain(rows)
    long = [(0, t, "u", str(t), None, None, None) for t in range(3000)] + [(1, t, "u", str(t), None, None, None) for t in range(2990)]
    got = P.prefix_trie(spark.createDataFrame(long, SCHEMA))
    assert got.agg(F.max("depth")).first()[0] == 3000 and got.where("n_convs = 2").count() >= 2990


def test_layouts_grow_and_keep_order():
    tree, keys = P.Radix(), [bytes([a, b, 7]) for a in (3, 200) for b in range(256)]
    for k in random.Random(1).sample(keys, len(keys)):
        tree.put(k, k)
    tree.put(keys[0][:2], b"inner")
    seen, stack, kinds = [], [tree.root], set()
    while stack:
        node = stack.pop()
        seen += node.ends
        kinds.add(type(node.layout).__name__)
        stack += reversed(node.children())
    assert seen == [b"inner", *keys] and {"Few", "Direct"} <= kinds
    for n, kind in ((4, P.Few), (16, P.Few), (17, P.Indexed), (48, P.Indexed), (49, P.Direct)):
        layout = P.Few()
        for b in range(n):
            layout = layout.put(b, b)
        assert type(layout) is kind and layout.children() == list(range(n)) and layout.get(n) is None
