"""Removal of byte strings that start in an earlier document, over range-partitioned suffixes.

A suffix array of every byte would be many times the corpus, so it is sparse. Each 50-byte string names one anchor: the
place, among its first ones, where a 24-byte run has the smallest hash. The choice depends on the string alone, so equal
strings have equal anchors at equal offsets, and the strings of a text fall into runs that share an anchor. Only anchors
that several documents have go on. Their suffixes, with the bytes that the run's strings need, are dealt to ranges by
their leading bytes between sampled splitters; equal anchors are always in one range, so no comparison crosses a
boundary. Each range sorts its strings by multikey sort and answers which of them an earlier document has.

Documents live in chunks, by a hash of doc_id; chunks and ranges exchange packed arrays, not rows. Whatever a chunk has
several times is sent once, so a passage of a third of all documents is a row for each chunk at most.
"""

from __future__ import annotations

import re
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, parts, ship, trimmed

LENGTH, RUN = 50, 24
SPREAD = LENGTH - RUN + 1  # anchors that a string chooses from, and strings that an anchor has at most: below 32
WIDTH = 80  # a suffix with its context: SPREAD - 1 + LENGTH bytes, its anchor's offset, its number of strings
#: Text bytes of a chunk and of what a part or range is about answerable for, so that tasks need little memory.
CHUNK_BYTES, PART_BYTES = 4 << 20, 8 << 20
BLOCK_BYTES = 1 << 18
#: Strings that a task sorts at once.
STRINGS = 200_000
LARGEST = np.iinfo(np.int64).max
_M = [0x9E3779B97F4A7C15]
for _ in range(3):
    _M.append(_M[-1] * _M[-1] % (1 << 64))
_M = [np.uint64(x) for x in _M]  # its 1st, 2nd, 4th and 8th power
_MIX = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def run_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the RUN = 24 bytes from each place on."""
    h1 = raw.astype(np.uint64) + np.uint64(1)
    h2 = h1[:-1] * _M[0] + h1[1:]
    h4 = h2[:-2] * _M[1] + h2[2:]
    h8 = h4[:-4] * _M[2] + h4[4:]
    h16 = h8[:-8] * _M[3] + h8[8:]
    return mix(h16[:-8] * _M[3] + h8[16:])


def block_anchors(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first string, number of strings, anchor, hash of its run) of each anchor of texts that end at ``ends``."""
    if len(raw) < LENGTH:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    hashes = run_hashes(raw)
    low = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    for step in (1, 2, 4, 8, SPREAD - 16):
        low = np.minimum(low[:-step], low[step:])
    inside = np.ones(len(low) + 1, bool)
    for e in ends.tolist():
        inside[max(0, e - LENGTH + 1) : e] = False
    at = np.flatnonzero(inside[:-1])
    if not len(at):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    anchor = (low[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))))
    count = np.diff(np.append(first, len(at)))
    return at[first], count, anchor[first], hashes[anchor[first]]


class Chunk:
    """The texts of a chunk as one run of bytes, and its anchors."""

    def __init__(self, ids: list, texts: list):
        raw = [(x or "").encode("utf-8", "surrogatepass") for x in texts]
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.ids = np.array([LARGEST if x is None else x for x in ids], np.int64)
        self.raw = np.frombuffer(b"".join(raw) + bytes(WIDTH), np.uint8)
        found, at, n = [], 0, len(raw)
        while at < n:  # blocks of whole texts, small enough for the processor's cache
            to = max(at + 1, int(np.searchsorted(self.ends, self.starts[at] + BLOCK_BYTES, "right")))
            lo, hi = int(self.starts[at]), int(self.ends[to - 1])
            a, count, p, h = block_anchors(self.raw[lo:hi], self.ends[at:to] - lo)
            found.append((a + lo, count, p + lo, h))
            at = to
        empty = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, np.uint64)]
        self.first, self.count, self.anchor, self.hash = (np.concatenate(x) for x in zip(*found, strict=True)) if found else empty
        self.doc = self.ids[np.searchsorted(self.ends, self.first, "right")]
        order = np.argsort(self.hash, kind="stable")
        self.keys, self.key_of, self.several = grouped(self.hash, order, self.doc)

    def shared(self, replies: np.ndarray) -> np.ndarray:
        """Anchors that several documents have, here or by the replies for each distinct hash."""
        return np.flatnonzero((self.several | replies)[self.key_of])

    def suffixes(self, rows: np.ndarray, splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The distinct suffixes of anchors ``rows`` by range: ranges, contexts, smallest ids; and which each row has."""
        context = contexts(self.raw, self.first[rows], self.count[rows], self.anchor[rows])
        lead = np.lib.stride_tricks.sliding_window_view(self.raw, 8)[self.anchor[rows]].copy().view(">u8").astype(np.uint64).ravel()
        range_ = np.searchsorted(splitters, lead, "right")
        order, group = distinct(context, range_)
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(order) else np.zeros(0, np.int64)
        of = np.empty(len(order), np.int64)
        of[order] = group
        ids = np.minimum.reduceat(self.doc[rows][order], first) if len(order) else np.zeros(0, np.int64)
        return range_[order[first]], context[order[first]], ids, of


def grouped(keys: np.ndarray, order: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order; which each row has; whether rows of a key are of several documents."""
    if not len(order):
        return keys, np.zeros(0, np.int64), np.zeros(0, bool)
    k, d = keys[order], doc[order]
    new = np.concatenate(([True], k[1:] != k[:-1]))
    first = np.flatnonzero(new)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return k[first], of, np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)


def contexts(raw: np.ndarray, first: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """The bytes that the strings of each anchor span, zeros behind, then the anchor's offset and the strings' number."""
    out = np.lib.stride_tricks.sliding_window_view(raw, WIDTH)[first].copy() if len(first) else np.zeros((0, WIDTH), np.uint8)
    out[np.arange(WIDTH)[None, :] >= (count + LENGTH - 1)[:, None]] = 0
    out[:, WIDTH - 2], out[:, WIDTH - 1] = anchor - first, count
    return out


def multikey(words: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of 8-byte words, and the number of its group of equal rows for each row in that order.

    Multikey sort: rows are ordered by one word, and the next word only orders rows that are still equal. ``start``
    is a key before the first word.
    """
    n, columns = len(words), [words[:, j] for j in range(words.shape[1])]
    if start is not None:
        columns.insert(0, start)
    order = np.argsort(columns[0], kind="stable")
    key = columns[0][order]
    new = np.concatenate(([True], key[1:] != key[:-1])) if n else np.zeros(0, bool)
    for column in columns[1:]:
        group = np.cumsum(new)
        tied = ~new
        tied[:-1] |= ~new[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        key = column[order[rows]]
        again = np.lexsort((key, group[rows]))
        order[rows], key = order[rows][again], key[again]
        new[rows[1:]] |= (key[1:] != key[:-1]) & (group[rows][1:] == group[rows][:-1])
    return order, np.cumsum(new) - 1


def distinct(context: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of suffixes by ``start`` and by what they hold, and the group of equal ones for each in that order."""
    words = context.view(np.uint64)
    code = np.zeros(len(words), np.uint64)
    for j in range(words.shape[1]):
        code = mix((code ^ words[:, j]) * _M[0] + np.uint64(j))
    order = np.lexsort((code, start))
    s, c = start[order], code[order]
    same = (s[1:] == s[:-1]) & (c[1:] == c[:-1])
    for j in range(words.shape[1]):  # word by word, so that no copy of all bytes is made
        w = words[:, j][order]
        if (same & (w[1:] != w[:-1])).any():  # two codes met: by all bytes then
            return multikey(np.column_stack([start.astype(np.uint64), words]))
    new = np.concatenate(([True], ~same)) if len(order) else np.zeros(0, bool)
    return order, np.cumsum(new) - 1


def bytes_at(context: np.ndarray, row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    """``n`` bytes of each of the suffixes ``row`` from ``place`` on."""
    return np.lib.stride_tricks.sliding_window_view(context.ravel(), n)[row * WIDTH + place].copy()


def answer(context: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each suffix a bit for each of its strings: whether a document with a smaller id has that string.

    ``ids`` has the smallest id that the sender knows for each. Equal suffixes are settled at once; only anchors that
    occur in different contexts have their strings sorted.
    """
    n = len(context)
    out = np.zeros(n, np.uint32)
    if not n:
        return out
    order, group = distinct(context, np.zeros(n, np.int64))
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    of = np.empty(n, np.int64)
    of[order] = group
    unique, least = context[order[first]], np.minimum.reduceat(ids[order], first)
    offset, count = unique[:, WIDTH - 2].astype(np.int64), unique[:, WIDTH - 1].astype(np.int64)
    every = ((np.uint64(1) << count.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    out = np.where(least[of] < ids, every[of], 0).astype(np.uint32)
    run = bytes_at(unique, np.arange(len(unique)), offset, RUN).view(np.uint64)
    by_run, run_group = multikey(run)
    sizes = np.bincount(run_group)
    mixed = sizes[run_group] > 1
    several = by_run[mixed]  # suffixes of anchors with several contexts, anchor by anchor
    if not len(several):
        return out
    before = np.full((len(several), SPREAD), LARGEST)  # the smallest id of each string
    slot = np.full(len(unique), -1)
    slot[several] = np.arange(len(several))
    edge = np.flatnonzero(np.concatenate(([True], np.diff(run_group[mixed]) != 0)))
    strings = np.concatenate(([0], np.cumsum(count[several])))
    at = 0
    while at < len(edge):  # some hundred thousand strings at a time, whole anchors
        to = at + 1
        while to < len(edge) and strings[edge[to]] - strings[edge[at]] < STRINGS:
            to += 1
        rows = several[edge[at] : edge[to] if to < len(edge) else len(several)]
        row = np.repeat(rows, count[rows])
        place = np.arange(len(row)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
        padded = np.zeros((len(row), 56), np.uint8)
        padded[:, :LENGTH] = bytes_at(unique, row, place, LENGTH)
        order, group = multikey(padded.view(np.uint64))
        first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        before[slot[row[order]], place[order]] = np.minimum.reduceat(least[row[order]], first)[group]
        at = to
    rows, shift = np.flatnonzero(slot[of] >= 0), np.arange(SPREAD, dtype=np.uint32)[None, :]
    for at in range(0, len(rows), STRINGS // SPREAD):
        some = rows[at : at + STRINGS // SPREAD]
        bits = before[slot[of[some]]] < ids[some, None]
        out[some] = (bits.astype(np.uint32) << shift).sum(axis=1, dtype=np.uint32)
    return out


def sliced(sorted_: np.ndarray, n: int) -> np.ndarray:
    """Bounds of the n parts of sorted part numbers."""
    return np.searchsorted(sorted_, np.arange(n + 1))


def part_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def message(to: str, chunk: int, ids: list[int], blobs: list[bytes], sent: str) -> pa.Table:
    return pa.table({to: pa.array(ids, pa.int32()), sent: pa.array([chunk] * len(ids), pa.int32()), "blob": pa.array(blobs, pa.binary())})


def _chunk(table: pa.Table) -> Chunk:
    return Chunk(table.column("doc_id").to_pylist(), table.column("text").to_pylist())


def _replies(chunk: Chunk, table: pa.Table, n: int) -> np.ndarray:
    bounds = sliced(part_of(chunk.keys, n), n)
    out = np.zeros(len(chunk.keys), bool)
    for part, blob in zip(table.column("part").to_pylist(), table.column("blob").to_pylist(), strict=True):
        lo, hi = bounds[part], bounds[part + 1]
        out[lo:hi] = np.unpackbits(np.frombuffer(blob, np.uint8), count=hi - lo)
    return out


def covered_bytes(docs: DataFrame, decoded: bool = False) -> DataFrame:
    """doc_id, text, n_bytes, n_removed, n_spans and kept (binary: the remaining bytes), or kept_text if ``decoded``:
    those of them that make whole characters. ``docs`` has doc_id and text; other columns may come as _x0, _x1, ...,
    and are passed on, others are left out.

    A byte is removed if a string of 50 bytes that covers it also starts in a document with a smaller doc_id, judged on
    the input. Null texts are empty; a null doc_id counts as the largest; rows of equal doc_id do not remove each
    other's bytes; texts under 50 bytes stay as they are; an empty table gives an empty table.
    """
    docs = docs.select("doc_id", "text", *[c for c in docs.columns if re.fullmatch(r"_x\d+", c)])
    spark = ship(docs).sparkSession
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    chunks, n = (max(parts(spark), ceil(total[0] / x)) for x in (CHUNK_BYTES, PART_BYTES))
    names, last = docs.columns, "kept_text" if decoded else "kept"
    rows = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "_chunk": F.pmod(F.xxhash64("doc_id"), F.lit(chunks)).cast("int")})
    splitters = sampled_splitters(docs, total[1], n)

    @trimmed
    def ask(table: pa.Table) -> pa.Table:
        """Of each distinct anchor 32 bits, to the part that its hash names."""
        chunk, key = _chunk(table), table.column("_chunk")[0].as_py()
        bounds = sliced(part_of(chunk.keys, n), n)
        low = (chunk.keys & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        full = np.flatnonzero(np.diff(bounds))
        return message("part", key, full.tolist(), [low[bounds[i] : bounds[i + 1]].tobytes() for i in full], "chunk")

    @trimmed
    def reply(table: pa.Table) -> pa.Table:
        """For each anchor whether several chunks have it; other anchors with these bits only make more work."""
        part = table.column("part")[0].as_py()
        got = [np.frombuffer(x, np.uint32) for x in table.column("blob").to_pylist()]
        _, of, times = np.unique(np.concatenate(got), return_inverse=True, return_counts=True)
        bits = np.split(times[of] > 1, np.cumsum([len(x) for x in got])[:-1])
        return pa.table({"chunk": table.column("chunk"), "part": pa.array([part] * len(got), pa.int32()), "kind": pa.array([0] * len(got), pa.int32()), "blob": pa.array([np.packbits(x).tobytes() for x in bits], pa.binary())})

    @trimmed
    def send(left: pa.Table, right: pa.Table) -> pa.Table:
        """The distinct suffixes of shared anchors, to the range of their leading bytes."""
        if not left.num_rows:
            return message("range", 0, [], [], "chunk")
        chunk, key = _chunk(left), left.column("_chunk")[0].as_py()
        range_, context, ids, _ = chunk.suffixes(chunk.shared(_replies(chunk, right, n)), splitters)
        bounds = sliced(range_, n)
        full = np.flatnonzero(np.diff(bounds))
        return message("range", key, full.tolist(), [ids[a:b].tobytes() + context[a:b].tobytes() for a, b in ((bounds[i], bounds[i + 1]) for i in full)], "chunk")

    @trimmed
    def settle(table: pa.Table) -> pa.Table:
        """The strings of a range that an earlier document has, as bits for each suffix sent."""
        part, blobs = table.column("range")[0].as_py(), table.column("blob").to_pylist()
        sizes = [len(x) // (WIDTH + 8) for x in blobs]
        ids = np.concatenate([np.frombuffer(x, np.int64, k) for x, k in zip(blobs, sizes, strict=True)])
        context = np.concatenate([np.frombuffer(x, np.uint8, offset=8 * k).reshape(-1, WIDTH) for x, k in zip(blobs, sizes, strict=True)])
        masks = np.split(answer(context, ids), np.cumsum(sizes)[:-1])
        return pa.table({"chunk": table.column("chunk"), "part": pa.array([part] * len(sizes), pa.int32()), "kind": pa.array([1] * len(sizes), pa.int32()), "blob": pa.array([x.tobytes() for x in masks], pa.binary())})

    @trimmed
    def cut(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return left.select(names).append_column("n_bytes", pa.array([], pa.int64())).append_column("n_removed", pa.array([], pa.int64())).append_column("n_spans", pa.array([], pa.int64())).append_column(last, pa.array([], pa.string() if decoded else pa.binary()))
        chunk = _chunk(left)
        kind = np.array(right.column("kind").to_pylist(), np.int64)
        rows = chunk.shared(_replies(chunk, right.take(pa.array(np.flatnonzero(kind == 0))), n))
        range_, _, ids, of = chunk.suffixes(rows, splitters)
        bounds, masks = sliced(range_, n), np.zeros(len(ids), np.uint32)
        for i in np.flatnonzero(kind == 1).tolist():
            part = right.column("part")[i].as_py()
            masks[bounds[part] : bounds[part + 1]] = np.frombuffer(right.column("blob")[i].as_py(), np.uint32)
        mask = np.where(chunk.doc[rows] > ids[of], np.uint32(0xFFFFFFFF), masks[of])
        hit = np.flatnonzero(mask)
        rows, mask = rows[hit], mask[hit]
        change = np.zeros(len(chunk.raw) + 1, np.int32)
        for k in range(SPREAD):
            at = chunk.first[rows[((mask >> np.uint32(k)) & np.uint32(1)).astype(bool) & (chunk.count[rows] > k)]] + k
            change[at] += 1  # a string starts at a place once
            change[at + LENGTH] -= 1
        gone = np.cumsum(change[:-1]) > 0
        size, start, end = chunk.sizes, chunk.starts, chunk.ends
        sums = np.concatenate(([0], np.cumsum(gone, dtype=np.int32)))
        begins = gone & ~np.concatenate(([False], gone[:-1]))
        begins[start[(size > 0)]] = gone[start[(size > 0)]]
        begun = np.concatenate(([0], np.cumsum(begins, dtype=np.int32)))
        removed = sums[end] - sums[start]
        kept = [chunk.raw[a:b].tobytes() if not r else chunk.raw[a:b][~gone[a:b]].tobytes() for a, b, r in zip(start.tolist(), end.tolist(), removed.tolist(), strict=True)]
        kept = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if decoded else pa.array(kept, pa.binary())
        out = left.select(names)
        for name, x in (("n_bytes", pa.array(size)), ("n_removed", pa.array(removed.astype(np.int64))), ("n_spans", pa.array((begun[end] - begun[start]).astype(np.int64))), (last, kept)):
            out = out.append_column(name, x)
        return out

    asked = rows.groupBy("_chunk").applyInArrow(ask, "part int, chunk int, blob binary")
    replies = asked.groupBy("part").applyInArrow(reply, "chunk int, part int, kind int, blob binary")
    sent = rows.groupBy("_chunk").cogroup(replies.groupBy("chunk")).applyInArrow(send, "range int, chunk int, blob binary")
    settled = sent.groupBy("range").applyInArrow(settle, "chunk int, part int, kind int, blob binary")
    types = rows.select(*names).schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add(last, "string" if decoded else "binary")
    return rows.groupBy("_chunk").cogroup(replies.unionByName(settled).groupBy("chunk")).applyInArrow(cut, types)


def sampled_splitters(docs: DataFrame, count: int, n: int) -> np.ndarray:
    """n - 1 splitters of the leading 8 bytes of suffixes, from a sample of about 4,000 documents."""

    def leads(batches):
        for batch in batches:
            chunk = Chunk([0] * batch.num_rows, batch.column(0).to_pylist())
            places = chunk.anchor[:: max(1, len(chunk.anchor) // 2000)]
            lead = np.lib.stride_tricks.sliding_window_view(chunk.raw, 8)[places].copy().view(">u8").astype(np.uint64).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([lead.tobytes()], pa.binary())], ["lead"])

    some = docs.select(F.col("text").cast("string")).sample(fraction=min(1.0, 4000 / max(count, 1)), seed=5)
    got = [np.frombuffer(r[0], np.uint64) for r in some.mapInArrow(leads, "lead binary").collect()]  # 16 kB a task
    lead = np.sort(np.concatenate([np.zeros(0, np.uint64), *got]))
    return np.unique(lead[(np.arange(1, n) * len(lead)) // n]) if len(lead) else lead


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with texts cut to the bytes that stay; part of a character left by a cut goes too; nulls stay null."""
    more = [c for c in docs.columns if c not in ("doc_id", "text")]
    made = covered_bytes(docs.select("doc_id", "text", *[F.col(named(c)).alias(f"_x{i}") for i, c in enumerate(more)]), decoded=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    back = {"doc_id": F.col("doc_id"), "text": text} | {c: F.col(f"_x{i}") for i, c in enumerate(more)}
    return made.select(*[back[c].alias(c) for c in docs.columns])
