"""BPE encoding through a table of distinct words, and decoding through a table of pieces.

Texts are split at blanks. A block of texts holds each of its words once and, for each place, the number of its word.
Words are dealt by hash, so that each distinct word of all blocks is encoded once; its ids go back to the blocks that
hold it and from there to the places. For decoding the ids of a block, each once, meet the id-to-piece table by a join.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import parts, scratch, ship, trim, trimmed

#: Bytes of text after which a block ends: few blocks hold few words twice, and one block fits a task many times over.
BLOCK_BYTES = 1 << 25
#: Steps of a tokenizer file under which no id depends on what lies beyond a blank.
FORM = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]


_tokenizers: dict = {}


class Numbers(dict):
    """A number for each key, in order of first use."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def tokenizer_of(path: str):
    """The tokenizer of a file; ValueError where ids could depend on text beyond a blank or where decoding has steps of its own."""
    if path in _tokenizers:
        return _tokenizers[path]
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    spec = json.loads(tokenizer.to_str())
    steps = [[x["type"] for x in (spec[k] or {}).get(name, [])] for k, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
    blanks = [x["content"] for x in spec["added_tokens"] if x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"] or x["content"].split() != [x["content"]]]
    if steps != list(FORM) or spec["model"]["type"] != "BPE" or not spec["pre_tokenizer"]["pretokenizers"][0]["invert"] or spec["decoder"] or blanks:
        raise ValueError(f"not a tokenizer of words without a decoder: {path}")
    _tokenizers[path] = tokenizer
    return tokenizer


def packed(numbers: np.ndarray) -> bytes:
    return pa.compress(numbers.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, count: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(raw, count * np.dtype(kind).itemsize, codec="zstd", asbytes=True) if count else b"", kind)


def gathered(starts: np.ndarray, lengths: np.ndarray, values: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The stretches of ``values`` that ``codes`` name, one behind the other."""
    n = lengths[codes]
    ends = np.cumsum(n)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n - starts[codes], n)]


def kept(df: DataFrame, what: str) -> DataFrame:
    """``df`` in the shared folder, tightly packed."""
    path = scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, what: str, key: str) -> DataFrame:
    """``df`` as ``kept``, in buckets by ``key``: later work by that key reads it where it lies, without a shuffle."""
    path = scratch(df.sparkSession, what)
    name = path.rsplit("/", 1)[1].replace("-", "_")
    df.write.option("compression", "zstd").option("path", path).bucketBy(parts(df.sparkSession), key).saveAsTable(name)
    return df.sparkSession.table(name)


def word_blocks(docs: DataFrame, deals: int) -> DataFrame:
    """(block, doc_ids, counts, codes, deals, lists): blocks of whole texts, each word once.

    A block's words are numbered by frequency, the most frequent first. codes has the number for every place of the
    texts, byte by byte of their places; deals has for each word the deal that its hash names; lists has the words of each
    deal, in order, joined by blanks and packed; counts are the words of each text.
    """
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("counts", T.ArrayType(T.IntegerType())), T.StructField("codes", T.BinaryType()), T.StructField("n_words", T.IntegerType()), T.StructField("deals", T.BinaryType())]
        + [T.StructField("lists", T.ArrayType(T.StructType([T.StructField("deal", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("words", T.BinaryType())])))]
    )
    arrow = [to_arrow_type(f.dataType) for f in schema]

    def block(number: int, ids: list, codes: list[np.ndarray], words: Numbers) -> pa.RecordBatch:
        flat = np.concatenate(codes)
        order = np.argsort(-np.bincount(flat, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        names = list(words)
        names = [names[i] for i in order]
        deal = np.fromiter((zlib.crc32(w) % deals for w in names), np.uint32, len(names))
        by_deal = np.argsort(deal, kind="stable")
        bounds = np.flatnonzero(np.diff(deal[by_deal].astype(np.int64), prepend=-1, append=-1)) if names else []
        lists = [(int(deal[by_deal[a]]), b" ".join(names[i] for i in by_deal[a:b])) for a, b in zip(bounds[:-1], bounds[1:])]
        lists = [{"deal": d, "size": len(w), "words": pa.compress(w, codec="zstd", asbytes=True)} for d, w in lists]
        row = number, ids, [len(c) for c in codes], packed(np.ascontiguousarray(rank[flat].view(np.uint8).reshape(-1, 4).T)), len(names), packed(deal), lists
        return pa.record_batch([pa.array([x], t) for x, t in zip(row, arrow)], names=schema.names)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, codes, words, size = [], [], Numbers(), 0
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    said = (text or b"").split()
                    ids.append(i)
                    codes.append(np.fromiter(map(words.__getitem__, said), np.uint32, len(said)))
                    size += len(text or b"") + 16
                    if size >= BLOCK_BYTES:
                        yield block(number, ids, codes, words)
                        number, ids, codes, words, size = number + 1, [], [], Numbers(), 0
        if ids:
            yield block(number, ids, codes, words)
        ids = codes = words = None
        trim()

    return bucketed(ship(docs.select("doc_id", "text")).mapInArrow(split, schema), "words", "block")


def encoded_lists(blocks: DataFrame, path: str) -> DataFrame:
    """(block, deal, lengths, ids, seen) for every list of words: the ids of each word; seen has each id once."""

    def encode(lists: pa.Table) -> pa.Table:
        words, codes = Numbers(), []
        for size, said in zip(lists.column("size").to_pylist(), lists.column("words").to_pylist()):
            said = pa.decompress(said, size, codec="zstd", asbytes=True).decode().split(" ")
            codes.append(np.fromiter(map(words.__getitem__, said), np.int64, len(said)))
        names, tokenizer = list(words), tokenizer_of(path)
        lengths, ids = np.zeros(len(names), np.int64), []
        for at in range(0, len(names), 5000):
            for k, e in enumerate(tokenizer.encode_batch_fast(names[at : at + 5000], add_special_tokens=False), at):
                lengths[k] = len(e.ids)
                ids.extend(e.ids)
        ids, starts = np.array(ids, "<u4"), np.cumsum(lengths) - lengths
        found = [gathered(starts, lengths, ids, c) for c in codes]
        return pa.table(
            {
                "block": lists.column("block"),
                "deal": lists.column("deal"),
                "lengths": pa.array([packed(lengths[c].astype("<u4")) for c in codes], pa.binary()),
                "n_words": pa.array(list(map(len, codes)), pa.int32()),
                "ids": pa.array([packed(x) for x in found], pa.binary()),
                "n_ids": pa.array(list(map(len, found)), pa.int32()),
                "seen": pa.array([np.unique(x).astype(np.int32) for x in found], pa.list_(pa.int32())),
            }
        )

    lists = blocks.select("block", F.inline("lists"))
    return lists.groupBy("deal").applyInArrow(trimmed(encode), "block long, deal int, lengths binary, n_words int, ids binary, n_ids int, seen array<int>")


def piece_table(df: DataFrame, path: str) -> DataFrame:
    """(id, piece) of a vocabulary, for joins."""
    tokenizer = tokenizer_of(path)
    pieces = [(i, tokenizer.id_to_token(i)) for i in range(tokenizer.get_vocab_size(with_added_tokens=True))]
    return df.sparkSession.createDataFrame(pieces, "id int, piece string").where("piece is not null")


def pieces_of_blocks(seen: DataFrame, path: str) -> DataFrame:
    """(block, ids, pieces): the ids of each block, in order, with their pieces; an id outside the vocabulary has none.

    A block has at most as many rows here as the vocabulary has ids.
    """
    once = seen.groupBy("block").agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("ids"))
    pairs = once.select("block", F.explode("ids").alias("id")).join(piece_table(seen, path), "id")
    one = pairs.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("id", "piece"))).alias("p"))
    return one.select("block", F.col("p.id").alias("piece_ids"), F.col("p.piece").alias("pieces"))


def said(ids: np.ndarray, counts: np.ndarray, of: pa.Table) -> pa.Array:
    """The text of each stretch of ids: its pieces with a blank between, those without a piece left out."""
    known = np.array(of.column("piece_ids")[0].as_py() if of.num_rows else [], ids.dtype)
    names = of.column("pieces")[0].as_py() if of.num_rows else []
    at = np.searchsorted(known, ids)
    at[at == len(known)] = 0
    fits = known[at] == ids if len(known) else np.zeros(len(ids), bool)
    ends, out, start = np.cumsum(counts), [], 0
    names = np.array(names, object)
    for end in ends:
        out.append(" ".join(names[at[start:end][fits[start:end]]].tolist()) if end > start and len(known) else "")
        start = end
    return pa.array(out, pa.string())


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every text: the ids of the tokenizer file, without special tokens, and what they decode to.

    A row for each row of ``docs``, repeated and null doc_ids too; a null or empty text, and one of blanks alone, has no
    ids and decodes to the empty text. Other columns are not read, whatever their names. An empty table gives none.
    """
    blocks = word_blocks(docs, 2 * parts(docs.sparkSession))
    lists = kept(encoded_lists(blocks, path), "lists")
    answers = lists.select("block", F.struct("deal", "lengths", "n_words", "ids", "n_ids").alias("list"), F.lit(None).cast("array<int>").alias("piece_ids"), F.lit(None).cast("array<string>").alias("pieces"))
    pieces = pieces_of_blocks(lists, path).select("block", F.lit(None).cast(answers.schema["list"].dataType).alias("list"), "piece_ids", "pieces")
    kind = to_arrow_type(docs.schema["doc_id"].dataType)

    def join(own: pa.Table, found: pa.Table) -> pa.Table:
        if not own.num_rows:
            return pa.table({"doc_id": pa.array([], kind), "ids": pa.array([], pa.list_(pa.int32())), "decoded": pa.array([], pa.string())})
        lists = sorted((x for x in found.column("list").to_pylist() if x), key=lambda x: x["deal"])
        lengths = np.concatenate([np.zeros(0, np.int64), *(unpacked(x["lengths"], x["n_words"], "<u4") for x in lists)]).astype(np.int64)
        ids = np.concatenate([np.zeros(0, "<u4"), *(unpacked(x["ids"], x["n_ids"], "<u4") for x in lists)]).astype(np.int32)
        counts = np.array(own.column("counts")[0].as_py(), np.int64)
        codes = np.ascontiguousarray(unpacked(own.column("codes")[0].as_py(), 4 * int(counts.sum()), "u1").reshape(4, -1).T).view("<u4").ravel()
        place = np.argsort(np.argsort(unpacked(own.column("deals")[0].as_py(), own.column("n_words")[0].as_py(), "<u4"), kind="stable"), kind="stable")
        codes = place[codes]
        starts, texts = np.cumsum(lengths) - lengths, np.concatenate([[0], np.cumsum(counts)])
        of, out_ids, out_said = found.filter(pa.compute.is_valid(found.column("pieces"))), [], []
        for at in range(0, len(counts), 500):  # some texts at a time: a block's ids take many times its words
            stops = texts[at : at + 501]
            own_codes = codes[stops[0] : stops[-1]]
            placed = gathered(starts, lengths, ids, own_codes)
            ends = np.concatenate([[0], np.cumsum(lengths[own_codes])])[stops - stops[0]]
            out_ids.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(placed, pa.int32())))
            out_said.append(said(placed, np.diff(ends), of))
        doc_ids = own.column("doc_ids").combine_chunks().values
        return pa.table({"doc_id": doc_ids.cast(kind), "ids": pa.chunked_array(out_ids), "decoded": pa.chunked_array(out_said)})

    schema = T.StructType([docs.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    own = blocks.select("block", "doc_ids", "counts", "codes", "n_words", "deals")
    return own.groupBy("block").cogroup(answers.unionByName(pieces).groupBy("block")).applyInArrow(trimmed(join), schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every text; odd rows as in ``round_trip``."""
    return round_trip(docs, path).select("doc_id", "ids")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, decoded) of every row of ``rows`` with ``ids``; null or empty ids decode to the empty text.

    Ids outside the vocabulary have no piece, as in the tokenizers library.
    """
    kind = rows.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("doc_ids", T.ArrayType(kind)), T.StructField("ids", T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField("seen", T.ArrayType(T.IntegerType()))])
    arrow = [to_arrow_type(f.dataType) for f in schema]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in (batch.slice(at, 2000) for at in range(0, batch.num_rows, 2000)):
                ids = [[i for i in x or [] if i is not None] for x in part.column(1).to_pylist()]
                row = number, part.column(0).to_pylist(), ids, sorted(set().union(*ids))
                yield pa.record_batch([pa.array([x], t) for x, t in zip(row, arrow)], names=schema.names)
                number += 1

    def join(own: pa.Table, found: pa.Table) -> pa.Table:
        ids = own.column("ids")[0].as_py() if own.num_rows else []
        flat, counts = np.array([i for x in ids for i in x], np.int64), np.array(list(map(len, ids)), np.int64)
        return pa.table({"doc_id": pa.array(own.column("doc_ids")[0].as_py() if own.num_rows else [], to_arrow_type(kind)), "decoded": said(flat, counts, found)})

    blocks = kept(ship(rows.select("doc_id", "ids")).mapInArrow(cut, schema), "ids")
    out = T.StructType([rows.schema["doc_id"], T.StructField("decoded", T.StringType())])
    return blocks.select("block", "doc_ids", "ids").groupBy("block").cogroup(pieces_of_blocks(blocks, path).withColumnRenamed("block", "of").groupBy("of")).applyInArrow(trimmed(join), out)


def token_digest(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``round_trip``; odd rows as there."""
    made = round_trip(docs, path)
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
