"""SimHash fingerprints and multi-index hashing: links between fingerprints that differ in a few bits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, fresh, named, row_hash, ship, trimmed, written


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 with seed 42 of each shingle of the A-Z lower-cased words of ``text``; a shorter text is one shingle."""
    from xxhash import xxh64_digest

    raw = text.encode("utf-8", "surrogatepass").lower().split()
    if not raw:
        return np.zeros(0, ">u8")
    joined = b" ".join(raw)
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    ends = np.cumsum(sizes + 1) - 1
    k = min(shingle, len(raw))
    first, last = (ends - sizes)[: len(raw) - k + 1].tolist(), ends[k - 1 :].tolist()
    return np.frombuffer(b"".join([xxh64_digest(joined[a:b], 42) for a, b in zip(first, last, strict=True)]), ">u8")


def fingerprint(text: str, shingle: int, words: int = 1) -> np.ndarray:
    """SimHash of the A-Z lower-cased words of ``text``, ``words`` times 64 bits: a bit is set if over half the shingle
    hashes set it. The first 64 bits are those of XXH64 with seed 42; further ones come from mixing it anew."""
    hashes = shingle_hashes(text, shingle)
    if not len(hashes):
        return np.zeros(words, np.uint64)
    votes = np.zeros((words, 64), np.int64)
    for at in range(0, len(hashes), 65536):
        h = hashes[at : at + 65536].astype(np.uint64)
        for j in range(words):
            votes[j] += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.packbits(votes * 2 > len(hashes), axis=1).view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, shingle: int = 4, words: int = 1, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, f0, f1, ...): the fingerprint of each whole text as signed 64-bit numbers; 0 where a text has no word."""
    names, n = [f"f{j}" for j in range(words)], len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(x.as_py() or "", shingle, words) for x in batch.column(n)], np.uint64).reshape(-1, words).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(fps[:, j]) for j in range(words))], [*keys, *names])

    return ship(docs).select(*[F.col(k).cast("long") for k in keys], F.col("text").cast("string")).mapInArrow(run, ", ".join(f"{c} long" for c in [*keys, *names]))


def segments(words: int, m: int, sure: int) -> list[tuple[int, int, int, int]]:
    """(word, shift, width, radius) of ``m`` segments of each 64-bit word, with balls by which no pair within ``sure``
    bits is lost: of sure = n * base + more, more + 1 of the n segments have radius base and the others base - 1."""
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    shifts = np.cumsum([0, *widths[:-1]]).tolist()
    base, more = divmod(sure, words * m)
    each = [(j, s, w) for j in range(words) for s, w in zip(shifts, widths, strict=True)]
    return [(*x, base if i <= more else base - 1) for i, x in enumerate(each)]


def ball(width: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of ``width`` bits."""
    from itertools import combinations

    return [sum(1 << i for i in c) for r in range(radius + 1) for c in combinations(range(width), r)]


def differing(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Number of differing bits between fingerprints, over the last axis."""
    return np.bitwise_count(one ^ many).sum(axis=-1, dtype=np.int32)


def spanning(fps: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links (i, j) that join what all pairs within ``bits`` bits join, one for each row but the first of a component.

    A component grows from a pivot; each member looks at rows that no component has yet, and of those only at such
    whose distance from the pivot can be near enough by the triangle inequality. So a dense group costs about its size.
    """
    links, left = [], np.arange(len(fps))
    while len(left) > 1:
        pivot, left = left[0], left[1:]
        away = differing(fps[pivot], fps[left])
        queue = [(pivot, 0)]
        while queue and len(left):
            row, own = queue.pop()
            look = np.flatnonzero(np.abs(away - own) <= bits)
            hit = look[differing(fps[row], fps[left[look]]) <= bits]
            if len(hit):
                links += [(int(row), int(x)) for x in left[hit]]
                queue += list(zip(left[hit].tolist(), away[hit].tolist(), strict=True))
                keep = np.ones(len(left), bool)
                keep[hit] = False
                left, away = left[keep], away[keep]
    return links


class Linker:
    """Joins rows within runs of rows of equal key; at its end each joined row has one link, to the smallest joined with it.

    So tasks that see the same group under other keys mostly name the same links.
    """

    SMALL = 24

    def __init__(self, bits: int):
        self.bits, self.up = bits, {}

    def top(self, x: int) -> int:
        up = self.up
        while (p := up.setdefault(x, x)) != x:
            up[x] = up[p]
            x = up[x]
        return x

    def join(self, pairs: list[tuple[int, int]]) -> None:
        for x, y in pairs:
            s, t = self.top(x), self.top(y)
            if s != t:
                self.up[max(s, t)] = min(s, t)

    def links(self) -> list[tuple[int, int]]:
        return [(x, t) for x in list(self.up) if (t := self.top(x)) != x]

    def runs(self, key: np.ndarray, node: np.ndarray, fps: np.ndarray) -> None:
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        size = np.diff(np.append(first, len(key)))
        for n in np.unique(size[(size > 1) & (size <= self.SMALL)]).tolist():  # all pairs of all short runs of a length at once
            at = first[size == n]
            i, j = np.triu_indices(n, 1)
            a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
            near = np.flatnonzero(differing(fps[a], fps[b]) <= self.bits)
            self.join(zip(node[a[near]].tolist(), node[b[near]].tolist(), strict=True))
        for at, n in zip(first[size > self.SMALL].tolist(), size[size > self.SMALL].tolist(), strict=True):
            own = node[at : at + n]
            self.join([(int(own[i]), int(own[j])) for i, j in spanning(fps[at : at + n], self.bits)])


def around(part: Column, tag: Column, masks: list[int]) -> Column:
    """Keys of the ball around a segment; a mask counts where its lowest bit is 0 in the segment."""
    lits = F.array(*[F.lit(m).cast("long") for m in masks])
    mine = F.filter(lits, lambda m: part.bitwiseAND(m).bitwiseAND(-m) == 0)
    return F.transform(mine, lambda m: part.bitwiseXOR(m) + tag)


def near_links(nodes: DataFrame, words: int, m: int, sure: int, bits: int) -> DataFrame:
    """(a, b): links between rows of ``nodes`` (node, f0, f1, ...) that join all found pairs within ``bits`` bits.

    Multi-index hashing. Every fingerprint is entered in a table for each segment, and it enumerates the small Hamming
    ball around each of its segments; what meets under a key is verified over all bits. Of a pair only the one whose
    lowest differing bit of the segment is 0 looks for the other, so half of a ball is enumerated. Rows are dealt by key
    and sorted, and each task passes on one link for each row that it joined, so a dense group is never written out as pairs.
    """
    names = [f"f{j}" for j in range(words)]
    keys = []
    for i, (j, shift, width, radius) in enumerate(segments(words, m, sure)):
        part = F.shiftrightunsigned(names[j], shift).bitwiseAND(F.lit((1 << width) - 1))
        if radius >= 0:
            keys.append(around(part, F.lit(i << 32).cast("long"), ball(width, radius)))  # the ball's centre is the entry

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        linker, held = Linker(bits), None
        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(2 + words)]
            now = columns[0], columns[1], np.column_stack(columns[2:]).view(np.uint64)
            if held is not None:
                now = tuple(np.concatenate(x) for x in zip(held, now, strict=True))
            cut = int(np.searchsorted(now[0], now[0][-1])) if len(now[0]) else 0  # the last key may go on
            held = tuple(x[cut:] for x in now)
            if cut:
                linker.runs(*(x[:cut] for x in now))
        if held is not None and len(held[0]):
            linker.runs(*held)
        found = linker.links()
        for at in range(0, len(found), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found[at : at + 10_000], strict=True)], ["a", "b"])

    rows = ship(nodes).select(F.explode(F.concat(*keys)).alias("key"), F.col("node").cast("long").alias("node"), *names)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, bits: int = 4, shingle: int = 4, words: int = 1, m: int = 3, sure: int | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id that links of at most ``bits`` differing bits reach, the row's own included. No
    pair within ``sure`` bits is missed (by default all of ``bits``); of those between, such with a segment within its
    ball are found. Null and empty texts have fingerprint 0 and are linked like any other; equal fingerprints are one
    node from the start, so a large group of copies makes no pairs; repeated rows stay rows; rows without doc_id link
    nothing; other columns are ignored.
    """
    names = [f"f{j}" for j in range(words)]
    fps = written(fingerprints(docs, shingle, words), "fingerprints")
    nodes = written(fps.groupBy(*names).agg(F.min("doc_id").alias("node")), "nodes")
    links = near_links(nodes.where("node is not null"), words, m, bits if sure is None else sure, bits)
    groups = connected_components(links).select("node", "root")
    every = written(nodes.join(groups, "node", "left").select(*names, F.coalesce("root", "node").alias("component_id")), "components")
    text = F.concat(*[F.lower(F.lpad(F.hex(n), 16, "0")) for n in names])
    return fps.join(every, names).select("doc_id", text.alias("fingerprint"), "component_id")


def alike(sets: list[np.ndarray], share: float) -> list[tuple[int, int]]:
    """Links (i, j) that join what all pairs of ``sets`` with a Jaccard similarity of ``share`` or more join.

    Components grow as in ``spanning``: one minus the similarity is a metric too. Empty sets are like nothing.
    """
    rows = np.array([i for i, x in enumerate(sets) if len(x)], np.int64)
    if len(rows) < 2:
        return []
    sizes = np.array([len(sets[i]) for i in rows], np.int64)
    codes = np.unique(np.concatenate([sets[i] for i in rows]), return_inverse=True)[1]
    starts, marked = np.cumsum(sizes) - sizes, np.zeros(codes.max() + 1, np.int64)

    def similarity(one: int, many: np.ndarray) -> np.ndarray:
        if not len(many):
            return np.zeros(0)
        own = codes[starts[one] : starts[one] + sizes[one]]
        n = sizes[many]
        ends = np.cumsum(n)
        marked[own] = 1
        both = np.add.reduceat(marked[codes[np.arange(ends[-1]) + np.repeat(starts[many] - ends + n, n)]], ends - n)
        marked[own] = 0
        return both / (sizes[one] + n - both)

    links, left = [], np.arange(len(rows))
    while len(left) > 1:
        pivot, left = left[0], left[1:]
        away = similarity(pivot, left)
        queue = [(pivot, 1.0)]
        while queue and len(left):
            row, own = queue.pop()
            fits = np.minimum(sizes[left], sizes[row]) >= share * np.maximum(sizes[left], sizes[row]) - 1e-6
            look = np.flatnonzero(fits & (np.abs(away - own) <= 1 - share + 1e-9))
            hit = look[similarity(row, left[look]) >= share]
            if len(hit):
                links += [(int(rows[row]), int(rows[x])) for x in left[hit]]
                queue += list(zip(left[hit].tolist(), away[hit].tolist(), strict=True))
                keep = np.ones(len(left), bool)
                keep[hit] = False
                left, away = left[keep], away[keep]
    return links


#: Candidates for near copies of five-word shingles: 256 bits, of which documents with four fifths of their shingles in
#: common differ in about 39, with a spread of 6; found by sixteen segments of 16 bits with balls of one bit each.
SIMILAR = {"bits": 57, "shingle": 5, "words": 4, "m": 4, "sure": 31}
#: A group of candidates with more rows is dealt to pairs of blocks of about so many, so that no task holds all of it.
BLOCK = 4000


def similar_groups(docs: DataFrame, share: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(doc_id, h, component_id, component_h) for every row of ``docs`` (doc_id, text) that has an id; h: its text's hash.

    component_id and component_h name the text of the smallest (doc_id, h) that links of texts with a Jaccard similarity
    of ``share`` or more reach. Fingerprints (``SIMILAR``) give groups of candidates; within a group, shingle sets
    decide, and any two members meet. Texts of equal fingerprints are one node, known by a number of its own, so that
    different texts of one doc_id are different nodes. Texts without a word are copies of each other.
    """
    names = [f"f{j}" for j in range(SIMILAR["words"])]
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), row_hash(F.col("text")).alias("h"), F.col("text").cast("string"))
    fps = written(fingerprints(docs, SIMILAR["shingle"], SIMILAR["words"], ("doc_id", "h")), "fingerprints")
    nodes = fps.groupBy(*names).agg(F.min(F.struct("doc_id", "h")).alias("head"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    groups = written(connected_components(near_links(nodes, SIMILAR["words"], SIMILAR["m"], SIMILAR["sure"], SIMILAR["bits"])), "groups")
    sized = groups.join(groups.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")), "root")
    own = sized.select("root", "node", "blocks", F.expr("CAST(pmod(xxhash64(node), blocks) AS INT)").alias("own"))
    dealt = own.select("root", "node", "blocks", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).where("blocks = 1 or own <> other")
    dealt = dealt.select("root", "node", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    heads = nodes.join(groups.select("node"), "node").select("node", F.col("head.doc_id").alias("doc_id"), F.col("head.h").alias("h"))
    texts = docs.join(heads, ["doc_id", "h"]).groupBy("node").agg(F.first("text").alias("text"))  # repeated rows are one
    members = dealt.join(texts, "node").select("root", "low", "high", "node", "text")

    @trimmed
    def link(group: pa.Table) -> pa.Table:
        node = group.column("node").to_pylist()
        sets = [np.unique(shingle_hashes(x.as_py() or "", SIMILAR["shingle"])) for x in group.column("text")]
        found = [(node[i], node[j]) for i, j in alike(sets, share)]
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    links = ship(members).groupBy("root", "low", "high").applyInArrow(link, "a long, b long")
    joined = nodes.join(connected_components(links), "node", "left").select(*names, "head", "root")
    tops = joined.where("root is not null").groupBy("root").agg(F.min("head").alias("top"))
    top = F.coalesce("top", "head")
    every = joined.join(tops, "root", "left").select(*names, top["doc_id"].alias("component_id"), top["h"].alias("component_h"))
    return fps.join(written(every, "components"), names).select("doc_id", "h", "component_id", "component_h")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one text of each group of near copies, that of the smallest doc_id; all columns stay.

    Of rows of equal doc_id and text one stays. Different texts of one doc_id are judged each; where they are near
    copies of each other, that of the smallest hash stays. Rows without doc_id all stay, for they are in no group.
    """
    (hash_,) = fresh(docs, "_hash")
    gone = similar_groups(docs).where("doc_id <> component_id or h <> component_h").select("doc_id", F.col("h").alias(hash_)).distinct()
    known = docs.where("doc_id is not null").withColumn(hash_, row_hash(F.col("text")))
    kept = known.join(gone, ["doc_id", hash_], "left_anti")
    row = F.struct(*[F.col(named(c)).alias(f"_{i}") for i, c in enumerate(docs.columns)])
    one = kept.groupBy("doc_id", hash_).agg(F.first(row).alias("_row"))  # partial results from each task
    once = one.select(*[F.col(f"_row._{i}").alias(c) for i, c in enumerate(docs.columns)])
    return once.unionByName(docs.where("doc_id is null"))
