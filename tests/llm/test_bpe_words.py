import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskrisk.llm import bpe_words as B
from maskrisk.llm.queries import op13_bpe

PATH = public_tokenizers.path("word_bpe_49k.json")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


T = Tokenizer.from_file(PATH)


def plain(text):
    ids = T.encode(text or "", add_special_tokens=False).ids
    return ids, T.decode(ids, skip_special_tokens=False)


def test_query_equals_the_library(spark, sf, docs):
    want = {}
    for r in docs.collect():
        ids, decoded = plain(r.text)
        want[r.doc_id] = len(ids), digest(" ".join(map(str, ids))), digest(decoded)
    got = op13_bpe(spark, sf).collect()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got} == want and len(got) == len(want)


def test_blanks_marks_and_letters_of_all_kinds(spark, monkeypatch):
    texts = ["a\x0bb\x0cc\rd\te", "Ésta's don't <|endoftext|>x<|startoftext|> y", "ΑΣ Σ οΣ ́x", "a b c\u0085d\x1ce", " ", "한국어 각 ﬀ ½² 日本語", "", None, " \n ", "İ ǅ ß", "x" * 9000, "é" + " é" * 3, "'s'S 've I'll 12a3 !!??"]
    made = B.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), PATH).collect()
    assert {r.doc_id: (r.ids, r.decoded) for r in made} == {i: plain(x) for i, x in enumerate(texts)}
    monkeypatch.setattr(B, "BLOCK_BYTES", 40)
    small = B.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH)
    assert {r.doc_id: r.ids for r in small.collect()} == {r.doc_id: r.ids for r in made}


def test_decode_of_stored_ids(spark):
    rows = [(1, [320, 1125, 49407]), (2, []), (3, None), (1, [5]), (4, [99999999, 7, None])]
    got = sorted((r.doc_id, r.decoded) for r in B.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), PATH).collect())
    assert got == sorted((i, T.decode([x for x in ids or [] if x is not None], skip_special_tokens=False)) for i, ids in rows)


def test_odd_rows(odd_docs, no_docs):
    got = B.token_digest(odd_docs, PATH).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.n_tokens) for r in got if r.doc_id is not None) == sorted((True, r.doc_id, len(plain(r.text)[0])) for r in odd_docs.collect() if r.doc_id is not None)
    assert len(got) == odd_docs.count() and B.token_digest(no_docs, PATH).count() == 0
    text_ids = B.token_digest(odd_docs.select(F.col("doc_id").cast("string"), "text"), PATH)
    assert dict(text_ids.dtypes)["doc_id"] == "string" and text_ids.count() == len(got)


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        B.tokenizer_of(public_tokenizers.path("byte_bpe_50k.json"))
