"""Line deduplication: documents that share lines are aligned by patience diff, and the later one loses what aligns."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, named, row_hash, ship, written


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned places (i, j) of equal items of ``a`` and ``b``, both rising; ``None`` items align with nothing.

    Equal beginnings and ends align; between them the longest rising run of items that are unique on both sides does,
    and the stretches between these are aligned in turn.
    """
    out, stack = [], [(0, len(a), 0, len(b))]
    while stack:
        i, m, j, n = stack.pop()
        while i < m and j < n and a[i] == b[j] and a[i] is not None:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1] and a[m - 1] is not None:
            m, n = m - 1, n - 1
            out.append((m, n))
        if i >= m or j >= n:
            continue
        in_a, in_b = Counter(a[i:m]), Counter(b[j:n])
        place = {x: k for k, x in enumerate(b[j:n], j) if in_b[x] == 1}
        common = [(k, place[x]) for k, x in enumerate(a[i:m], i) if x is not None and in_a[x] == 1 and x in place]
        tops, chain = [], []  # the ends of the best runs by length, and what comes before each pair
        for k, (_, y) in enumerate(common):
            at = bisect_left(tops, y, key=lambda t: common[t][1])
            chain.append(tops[at - 1] if at else -1)
            tops[at : at + 1] = [k]
        run, k = [], tops[-1] if tops else -1
        while k >= 0:
            run.append(common[k])
            k = chain[k]
        if not run:
            continue
        p, q = i, j
        for x, y in reversed(run):
            out.append((x, y))
            stack.append((p, x, q, y))
            p, q = x + 1, y + 1
        stack.append((p, m, q, n))
    return sorted(out)


#: Seeds of the two hashes of a line: by one documents meet, by the other their lines are compared.
MEET, COMPARE = 42, 43


def line_hashes(text: Column, seed: int) -> Column:
    """A hash of each line feed-split line; null for a line without a word."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    return F.transform(lines, lambda x: F.when(F.btrim(x, F.lit(" \t\n\x0b\f\r")) != "", F.xxhash64(F.lit(seed), x)))


def blocks(lines: Column) -> Column:
    """(block, once): hashes of each line (once: it is in the text one time only), of each two adjacent lines, of the
    first line as first and the last as last, and of more than two lines as a whole."""
    order = F.array_sort(lines)
    again = F.array_distinct(F.filter(F.zip_with(order, F.slice(order, 2, F.size(order)), lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull()))
    twos = F.filter(F.zip_with(lines, F.slice(lines, 2, F.size(lines)), lambda x, y: F.when(y.isNotNull(), F.xxhash64(x, y))), lambda x: x.isNotNull())
    ends = F.when(F.size(lines) > 1, F.array(F.xxhash64(F.lit(0), F.lit(0), lines[0]), F.xxhash64(F.lit(0), F.lit(1), F.element_at(lines, -1)))).otherwise(F.array().cast("array<bigint>"))
    whole = F.when(F.size(lines) > 2, F.array(F.xxhash64(lines))).otherwise(F.array().cast("array<bigint>"))

    def marked(hashes: Column, once: bool) -> Column:
        return F.transform(hashes, lambda x: F.struct(x.alias("block"), F.lit(once).alias("once")))

    return F.concat(marked(F.array_except(lines, again), True), marked(again, False), marked(F.array_distinct(F.concat(twos, ends, whole)), True))


def aligned_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, h, gone): for each text (h: its hash) that loses lines, their numbers from 0.

    A text is aligned with the first one (by doc_id) of each of its lines, the first one that has the line one time only,
    the first ones of each two lines that follow each other (lines without a word left out), of its first line as first
    and its last as last, and of all its lines as a whole, however many texts have them. A group of n documents that
    share lines thus gives n - 1 pairs for each first document, never all pairs. Texts meet by one hash of a line and
    are compared by another, so lines that differ would have to agree in 128 bits.

    Rows of equal doc_id and text are one; rows of equal doc_id with different texts are each aligned with documents of
    smaller doc_id only. Rows without doc_id and null texts have no lines.
    """
    known = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), row_hash(F.col("text")).alias("h"), F.col("text").cast("string"))
    said = F.filter(line_hashes(F.col("text"), MEET), lambda x: x.isNotNull())
    each = known.select("doc_id", "h", said.alias("said")).select("doc_id", "h", F.inline(blocks(F.col("said"))))
    each = written(each, "blocks")
    row = F.struct("doc_id", "h")
    met = each.groupBy("block").agg(F.min(row).alias("first"), F.min(F.when(F.col("once"), row)).alias("first_once"), F.max("doc_id").alias("last"))
    met = written(met.where("first.doc_id < last").select("block", F.array_distinct(F.array("first", F.coalesce("first_once", "first"))).alias("firsts")), "met")
    pairs = each.join(met, "block").select("doc_id", "h", F.explode("firsts").alias("first")).where("doc_id > first.doc_id")
    pairs = pairs.select("doc_id", "h", F.col("first.doc_id").alias("o"), F.col("first.h").alias("oh"))
    pairs = written(pairs.distinct(), "pairs")
    lines = known.groupBy("doc_id", "h").agg(F.first(line_hashes(F.col("text"), COMPARE)).alias("lines"))
    lines = written(lines, "lines")
    both = pairs.join(lines, ["doc_id", "h"]).join(lines.select(F.col("doc_id").alias("o"), F.col("h").alias("oh"), F.col("lines").alias("earlier")), ["o", "oh"])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 128):  # a common line's first document may be long and is in many rows
                some = batch.slice(at, 128)
                gone = [[j for _, j in patience(x, y)] for x, y in zip(some.column(2).to_pylist(), some.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(gone, pa.list_(pa.int32()))], ["doc_id", "h", "gone"])

    found = ship(both).select("doc_id", "h", "earlier", "lines").mapInArrow(align, "doc_id long, h long, gone array<int>")
    lost = found.select("doc_id", "h", F.explode("gone").alias("line")).distinct()  # so that none is gathered twice
    return lost.groupBy("doc_id", "h").agg(F.collect_list("line").alias("gone"))  # a text's own lines


def without_lines(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, more) with texts without the lines that align with an earlier document's.

    All rows and columns stay, also documents that lose every line (their text is empty). Null texts stay null; rows
    without doc_id stay as they are; repeated rows do not remove each other's lines, and each loses what its own text
    shares with documents of smaller doc_id; an empty table gives an empty table.
    """
    doc, hash_, lost = fresh(docs, "_doc", "_hash", "_gone")
    gone = aligned_lines(docs).select(F.col("doc_id").alias(doc), F.col("h").alias(hash_), F.col("gone").alias(lost))
    joined = docs.join(gone, (docs["doc_id"] == gone[doc]) & (row_hash(docs["text"]) == gone[hash_]), "left")

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(lost))  # by a hash set, so linear
        return F.array_join(F.transform(stay, lambda i: lines[i]), "\n")

    kept = F.transform(F.array(F.split("text", "\n")), rest)[0]  # the lines are split once, not for each line
    return joined.select(*[(F.when(F.col(lost).isNull(), F.col("text")).otherwise(kept).alias("text") if c == "text" else F.col(named(c))) for c in docs.columns])


def line_digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines (of the input), kept_chars, kept_sha256 for every row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    before = docs.select("doc_id", text.alias("text"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"))
    after = without_lines(before)
    return after.select("doc_id", "n_lines", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))
