"""Token sequences of a fixed capacity, filled by the minimum-bin-slack rule."""

from __future__ import annotations

import json
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, named, ship, written

#: Words, and parts of words, whose ids a Python worker remembers.
REMEMBERED = 300_000
#: Pieces of a slice of a length class, about: a length which most pieces share is ranked by many tasks. A class of fewer
#: pieces has slices of SMALL_ROWS, FEW of them at most.
SLICE_ROWS, SMALL_ROWS, FEW = 20_000, 250, 16


def slices_of(count: int) -> int:
    return max(1, -(-count // SLICE_ROWS), min(FEW, -(-count // SMALL_ROWS)))


_encoders: dict[str, Encoder] = {}


class Encoder:
    """A tokenizer file in a Python worker, with the ids of common words and word parts remembered.

    Where the file lower-cases, drops white space and splits by one pattern before byte-level merges, no id depends on
    what lies beyond a blank, so a text's ids are those of its words. Any other file, a text with the marker of a
    special token, and a word with unusual characters go to the tokenizer as they are.
    """

    FORM = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = [[x["type"] for x in (spec[k] or {}).get(name, [])] for k, name in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.by_word = steps == list(self.FORM) and spec["model"]["type"] == "BPE" and spec["pre_tokenizer"]["pretokenizers"][0]["invert"]
        self.marks = [x["content"] for x in spec["added_tokens"]]
        self.words: dict[str, bytes] = {"": b""}
        if self.by_word:
            self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            self.parts: dict[str, bytes] = {}
            shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # byte-level alphabet: these as they are
            rest = [b for b in range(256) if b not in shown]
            self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def part(self, text: str) -> bytes:
        if (out := self.parts.get(text)) is None:
            merged = self.tokenizer.model.tokenize(text.encode().decode("latin-1").translate(self.alphabet))
            out = struct.pack(f"<{len(merged)}I", *[t.id for t in merged])
            if len(self.parts) < REMEMBERED:
                self.parts[text] = out
        return out

    def word(self, text: str) -> bytes:
        if not text.isprintable() or "\u03a3" in text or not unicodedata.is_normalized("NFC", text):
            out = self.whole(text)
        else:
            low = text.lower()
            if low.isalpha():
                out = self.part(low)
            elif low[:-1].isalpha() and low[-1] in ",.!?:;":
                out = self.part(low[:-1]) + self.part(low[-1])
            else:
                out = b"".join(map(self.part, self.pattern.findall(low)))
        if len(self.words) < REMEMBERED:
            self.words[text] = out
        return out

    def encode(self, text: str) -> bytes:
        if not self.by_word or any(x in text for x in self.marks):
            return self.whole(text)
        words = text.replace("\n", " ").split(" ")
        ids = list(map(self.words.get, words))
        if None in ids:
            ids = [self.word(w) if x is None else x for w, x in zip(words, ids, strict=True)]
        return b"".join(ids)


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers, without special tokens."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return list(map(_encoders[path].encode, texts))


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """(doc_id, piece, start, length, ids): each text's ids and a closing id 0, cut where longer than ``capacity``.

    A null or empty text has the closing id alone. ids is binary: little-endian unsigned 32-bit numbers.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 1000) for at in range(0, batch.num_rows, 1000)):
                rows = []
                texts = [x or "" for x in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), encode_texts(texts, tokenizer_path), strict=True):
                    ids += b"\0\0\0\0"
                    n = len(ids) // 4
                    rows += [(doc, at // capacity, at, min(capacity, n - at), ids[4 * at : 4 * (at + capacity)]) for at in range(0, n, capacity)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "piece", "start", "length", "ids"])

    return ship(docs).select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, each at most as often as counted, with the largest sum within ``room``; longer ones are preferred.

    Subset sums as bits of one integer: bit s is set if the lengths seen so far can make s.
    """
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for n in sorted((x for x in counts if x <= room), reverse=True):
        left, take = min(counts[n], room // n), 1
        while left > 0:
            take = min(take, left)
            steps.append((reach, n, take))
            reach |= (reach << (n * take)) & mask
            left -= take
            take *= 2
            if reach >> room & 1:
                break
        if reach >> room & 1:
            break
    s, out = reach.bit_length() - 1, []
    for before, n, take in reversed(steps):
        if not before >> s & 1:
            out += [n] * take
            s -= n * take
    return out


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Patterns of (length, copies) and how many bins use each, for so many pieces of each length.

    Minimum bin slack: a bin starts with the longest piece left, the fullest feasible combination completes it and is
    removed; the same bin is taken again as long as the counts last. Works on counts by length alone, at most
    ``capacity`` of them, however many pieces there are.
    """
    left, out = {n: c for n, c in counts.items() if c}, []
    while left:
        first = max(left)
        rest = {**left, first: left[first] - 1}
        bin_ = [first, *fullest({n: c for n, c in rest.items() if c}, capacity - first)]
        copies = {n: bin_.count(n) for n in sorted(set(bin_), reverse=True)}
        times = min(left[n] // k for n, k in copies.items())
        for n, k in copies.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        out.append((list(copies.items()), times))
    return out


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length, any more columns) with sequence_id and offset: every piece gets its place.

    ``pieces`` should be a written table: it is read for the counts and again for the places. Only the number of
    pieces of each length comes to the driver. Pieces of one length are interchangeable, so each is ranked within a
    slice of its length class, and the plan turns ranks into places. An empty table gives an empty table.
    """
    slice_, rank, before_, n_ = fresh(pieces, "_slice", "_rank", "_before", "_n")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # capacity rows at most
    slices = F.array(*[F.lit(slices_of(counts.get(n, 0))) for n in range(max(counts, default=0) + 1)])
    sliced = pieces.withColumn(slice_, F.pmod(F.xxhash64("doc_id", "piece"), F.get(slices, F.col("length").cast("int"))))
    sizes = sliced.groupBy("length", slice_).agg(F.count("*").alias(n_))
    lengths, starts, stops, copies, bases, offsets = [], [], [], [], [], []
    base, used = 0, dict.fromkeys(counts, 0)
    for pattern, times in plan_bins(counts, capacity):
        at = 0
        for n, k in pattern:
            lengths.append(n)
            starts.append(used[n])
            copies.append(k)
            bases.append(base)
            offsets.append(at)
            used[n] += k * times
            at += n * k
        base += times
    order = np.lexsort((starts, lengths))
    plan = [np.array(x, np.int64)[order] for x in (lengths, starts, copies, bases, offsets)]
    before = sizes.withColumn(before_, F.coalesce(F.sum(n_).over(W.partitionBy("length").orderBy(slice_).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    order_by = ["doc_id", "piece", *[named(c) for c in names if c not in ("doc_id", "piece", "length", "ids")]]
    ranked = (
        sliced.withColumn(rank, F.row_number().over(W.partitionBy("length", slice_).orderBy(*order_by)) - 1)
        .join(before.select("length", slice_, before_), ["length", slice_])  # dealt as the window before it
        .select(*map(named, names), (F.col(rank) + F.col(before_)).cast("long").alias(rank))
    )
    schema = ranked.select(*map(named, names), F.col(rank).alias("sequence_id"), F.col(rank).alias("offset")).schema

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, start, copy, first, offset = plan
        for batch in batches:
            n, r = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", rank))
            lo, hi = np.searchsorted(length, n, "left"), np.searchsorted(length, n, "right")
            while (lo + 1 < hi).any():  # the last start of this length that is at most the rank
                mid = (lo + hi) // 2
                right = (lo + 1 < hi) & (start[np.minimum(mid, len(start) - 1)] <= r)
                lo, hi = np.where(right, mid, lo), np.where(right | (lo + 1 >= hi), hi, mid)
            q = r - start[lo]
            places = [pa.array(first[lo] + q // copy[lo]), pa.array(offset[lo] + q % copy[lo] * n)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *places], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: every document's ids in its places."""
    return pack(written(token_pieces(docs, tokenizer_path, capacity), "pieces"), capacity)


def packing_digest(docs: DataFrame, tokenizer_path: str, capacity: int = 2048) -> DataFrame:
    """As ``pack_documents``, with the crc32 of each piece's ids in place of the ids."""
    pieces = token_pieces(docs, tokenizer_path, capacity)
    pieces = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(written(pieces, "pieces"), capacity)
