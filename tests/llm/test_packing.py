import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from maskrisk.llm import packing as K
from maskrisk.llm.queries import op10_packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def placed(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_query_has_every_id_in_few_sequences(spark, sf, docs):
    t = Tokenizer.from_file(PATH)
    ids = {r.doc_id: [*t.encode(r.text, add_special_tokens=False).ids, 0] for r in docs.collect()}
    rows = op10_packing(spark, sf).collect()
    want = {(i, at // 2048): (at, len(x[at : at + 2048]), zlib.crc32(np.array(x[at : at + 2048], "<u4").tobytes())) for i, x in ids.items() for at in range(0, len(x), 2048)}
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    assert placed(rows, 2048) <= -(-sum(map(len, ids.values())) // 2048) + 1


def test_words_are_encoded_as_in_their_text():
    t = Tokenizer.from_file(PATH)
    texts = ["Ésta's don't <|endoftext|> x", "ΑΣ Σ οΣ", "á é\tx\x1cy z ́x", "İstanbul ǅ ß ﬀ 12 ½ ²", "", "\n \n", "日本語。テスト，a1b2", "é,x", "\x01 \x00 w", "thing###,a!!b?"]
    for x, got in zip(texts, K.encode_texts(texts, PATH)):
        assert np.frombuffer(got, "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_fullest_against_all_subsets():
    rng = random.Random(1)
    for _ in range(60):
        counts = {rng.randint(1, 15): rng.randint(1, 3) for _ in range(4)}
        room = rng.randint(1, 30)
        sums = {0}
        for n, c in counts.items():
            sums = {s + n * k for s in sums for k in range(c + 1) if s + n * k <= room}
        got = K.fullest(counts, room)
        assert sum(got) == max(sums) and all(got.count(n) <= counts[n] for n in got)


def test_plan_uses_every_piece_once():
    counts = {7: 5, 3: 11, 10: 2, 1: 1}
    plan, used = K.plan_bins(counts, 10), {}
    for pattern, times in plan:
        assert sum(n * k for n, k in pattern) <= 10
        for n, k in pattern:
            used[n] = used.get(n, 0) + k * times
    assert used == counts and K.plan_bins({}, 10) == []


def test_odd_rows(spark, odd_docs, no_docs):
    rows = K.pack_documents(odd_docs, PATH, 64).collect()
    placed(rows, 64)
    assert [r.length for r in rows if r.doc_id in (3, 4, 5)] == [1, 1, 1] and sum(r.doc_id == 2 and r.piece == 0 for r in rows) == 2
    assert all(len(r.ids) == 4 * r.length for r in rows)
    assert K.pack_documents(no_docs, PATH, 64).count() == 0
    clash = spark.createDataFrame([(1, 0, 5, "a", "b"), (2, 0, 5, "c", "d")], "doc_id long, piece int, length long, _rank string, _slice string")
    out = K.pack(clash, 10).collect()
    assert {(r.doc_id, r._rank, r._slice) for r in out} == {(1, "a", "b"), (2, "c", "d")} and placed(out, 10) == 1
