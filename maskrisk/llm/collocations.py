"""Phrase collocations: mergeable Misra-Gries summaries find every phrase that may be frequent, a second pass counts these.

Texts become blocks of word numbers. In the first pass each block deals the hashes of its phrases, with their counts, to
hash partitions. A partition merges them into a Misra-Gries summary whose capacity exceeds its mass divided by the
threshold, so that each merge loses less than the threshold of any phrase in all, and no frequent phrase can be lost.
What survives goes back to the blocks that have it. The second pass counts it there by the words themselves, so that
equal hashes of different phrases change no count.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe_words import Numbers, kept, packed, unpacked
from .common import parts, ship, trim, trimmed, written

#: Bytes of text after which the blocks of a task end.
BLOCK_BYTES = 1 << 25
#: Occurrences of phrases in a hash partition, about.
DEAL_MASS = 6_000_000
#: A-Z become a-z; what separates pieces becomes a line break, a tab a blank.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz" + b"\n" * 9 + b" ")
#: Odd multipliers that mix 64-bit hashes.
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def word_blocks(docs: DataFrame) -> DataFrame:
    """(block, lang, n, size, codes, words): texts of one language; codes has 0 where a piece ends and else the number of a word.

    Null texts are empty; a null lang is ``und``. n counts words, size codes.
    """

    def blocks(number: int, state: dict) -> Iterator[pa.RecordBatch]:
        for lang, (words, codes) in state.items():
            codes = np.concatenate(codes)
            names = list(words)[2:]
            row = {"block": number, "lang": lang, "n": int((codes > 0).sum()), "size": len(codes), "codes": packed(codes), "words": b"\n".join(names).decode()}
            if row["n"]:
                yield pa.record_batch([pa.array([v], t) for v, t in zip(row.values(), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()))], names=list(row))
            number += 1

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, state, size = TaskContext.get().partitionId() << 32, {}, 0
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    if lang not in state:
                        state[lang] = Numbers({b"\n": 0, b"": 1}), []
                    words, codes = state[lang]
                    said = (text or b"").translate(FOLD).replace(b"\n", b" \n ").split(b" ")
                    said = np.fromiter(map(words.__getitem__, said), np.uint32, len(said))
                    said = said[said != 1]
                    codes.append(np.append(np.where(said > 0, said - 1, 0).astype(np.uint32), np.uint32(0)))
                    size += len(text or b"") + 16
                if size >= BLOCK_BYTES:
                    yield from blocks(number, state)
                    number, state, size = number + len(state), {}, 0
        yield from blocks(number, state)
        state = None
        trim()

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    return kept(ship(rows).mapInArrow(split, "block long, lang string, n long, size long, codes binary, words string"), "blocks")


def phrase_hashes(codes: np.ndarray, words: list[str], lang: str, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, hashes): where phrases of each length begin within their piece, and a hash of language and words."""
    seed = xxhash.xxh64_intdigest(lang)
    of_word = np.array([0, *(xxhash.xxh64_intdigest(w, seed) for w in words)], np.uint64)[codes]
    inside, places, now = codes > 0, np.flatnonzero(codes), of_word[codes > 0]
    yield 1, places, now
    for n in range(2, longest + 1):
        fits = places + n - 1 < len(codes)
        fits[fits] = inside[places[fits] + n - 1]
        places, now = places[fits], now[fits]
        now = now * MIX[0] + of_word[places + n - 1]
        now ^= now >> np.uint64(29)
        now *= MIX[1]
        now ^= now >> np.uint64(32)
        yield n, places, now


def planes(sorted_hashes: np.ndarray) -> bytes:
    """Ascending hashes as differences, byte by byte of their places, so that leading zeros pack."""
    steps = np.diff(sorted_hashes, prepend=np.uint64(0))
    return packed(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T))


def from_planes(raw: bytes, count: int) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(unpacked(raw, 8 * count, "u1").reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


class Summary:
    """A Misra-Gries summary of weighted hashes: counters, and how much any hash may have lost."""

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Another summary of distinct keys: counters are added, and the largest that does not fit is taken from all."""
        both, at = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        sums = np.bincount(at, np.concatenate([self.counts, counts]), len(both)).astype(np.int64)
        if len(both) > self.capacity:
            cut = int(np.partition(sums, len(sums) - self.capacity - 1)[len(sums) - self.capacity - 1])
            self.lost += cut
            both, sums = both[sums > cut], sums[sums > cut] - cut
        self.keys, self.counts = both, sums

    def may_reach(self, threshold: int) -> np.ndarray:
        """Hashes, ascending, whose true count may be ``threshold`` or more."""
        return self.keys[self.counts + self.lost >= threshold]


def may_be_frequent(blocks: DataFrame, threshold: int, longest: int, deals: int) -> DataFrame:
    """(block, length, hashes, count): for each block the hashes of its phrases that some summary kept, ascending."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = unpacked(row["codes"], row["size"], "<u4")
                for n, _, found in phrase_hashes(codes, row["words"].split("\n"), row["lang"], longest):
                    found = np.sort(found)
                    first = np.flatnonzero(np.append(True, found[1:] != found[:-1])[: len(found)])
                    counts, found = np.diff(first, append=len(found)).astype("<u4"), found[first]
                    to = ((found >> np.uint64(32)) * np.uint64(deals) >> np.uint64(32)).astype(np.int32)
                    bounds = np.flatnonzero(np.diff(to, prepend=-1, append=-1))
                    spans = list(zip(bounds[:-1], bounds[1:])) if len(to) else []
                    yield pa.record_batch(
                        [
                            pa.array([int(to[a]) for a, _ in spans], pa.int32()),
                            pa.array([row["block"]] * len(spans), pa.int64()),
                            pa.array([n] * len(spans), pa.int32()),
                            pa.array([planes(found[a:b]) for a, b in spans], pa.binary()),
                            pa.array([packed(counts[a:b]) for a, b in spans], pa.binary()),
                            pa.array([b - a for a, b in spans], pa.int64()),
                            pa.array([int(counts[a:b].sum()) for a, b in spans], pa.int64()),
                        ],
                        names=["deal", "block", "length", "hashes", "counts", "count", "mass"],
                    )
            trim()

    def survivors(dealt: pa.Table) -> pa.Table:
        rows = dealt.to_batches()
        each = lambda: (x for b in rows for x in b.to_pylist())
        summary = Summary(int(sum(x["mass"] for x in each())) // threshold + 1)
        for x in each():
            summary.merge(from_planes(x["hashes"], x["count"]), unpacked(x["counts"], x["count"], "<u4"))
        kept_hashes, out = summary.may_reach(threshold), []
        for x in each():
            own = np.intersect1d(from_planes(x["hashes"], x["count"]), kept_hashes, assume_unique=True)
            if len(own):
                out.append((x["block"], x["length"], planes(own), len(own)))
        columns = list(zip(*out)) or [[], [], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.int64()))], names=["block", "length", "hashes", "count"])

    dealt = ship(blocks).mapInArrow(deal, "deal int, block long, length int, hashes binary, counts binary, count long, mass long")
    return dealt.groupBy("deal").applyInArrow(trimmed(survivors), "block long, length int, hashes binary, count long")


def frequent_phrases(blocks: DataFrame, threshold: int, longest: int) -> DataFrame:
    """(lang, phrase, length, f): every phrase of up to ``longest`` words with f = ``threshold`` occurrences or more, exactly."""
    mass = longest * (blocks.agg(F.sum("n")).first()[0] or 0)
    deals = max(parts(blocks.sparkSession), -(-mass // DEAL_MASS))
    kept_hashes = may_be_frequent(blocks, threshold, longest, deals)

    def count(own: pa.Table, found: pa.Table) -> pa.Table:
        out: list[tuple[list, np.ndarray, int]] = []
        for row in own.to_pylist():
            codes, words = unpacked(row["codes"], row["size"], "<u4"), row["words"].split("\n")
            hashes = {n: [] for n in range(1, longest + 1)}
            for x in found.to_pylist():
                hashes[x["length"]].append(from_planes(x["hashes"], x["count"]))
            rank = np.full(len(codes), -1, np.int64)  # of the phrase of the length before at each place
            for n, places, now in phrase_hashes(codes, words, row["lang"], longest):
                some = np.sort(np.concatenate([np.zeros(0, np.uint64), *hashes[n]]))
                at = np.searchsorted(some, now)
                at[at == len(some)] = 0
                places = places[(some[at] == now) if len(some) else np.zeros(len(now), bool)]
                # a frequent phrase begins with a frequent one, which has a rank
                places = places[rank[places] >= 0] if n > 1 else places
                key = codes[places].astype(np.int64) if n == 1 else rank[places] << 32 | codes[places + n - 1]
                _, first, inverse, counts = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
                rank = np.full(len(codes), -1, np.int64)
                rank[places] = inverse
                out.append(([" ".join(words[c - 1] for c in codes[p : p + n]) for p in places[first].tolist()], counts, n))
        # packed by the deal of the phrase, as hashes are: a row for each phrase of each block would be many more bytes
        said: dict[tuple[int, int], tuple[list, list]] = {}
        for phrases, counts, n in out:
            for phrase, c in zip(phrases, counts.tolist()):
                to = said.setdefault((zlib.crc32(phrase.encode()) % deals, n), ([], []))
                to[0].append(phrase)
                to[1].append(c)
        return pa.table(
            {
                "deal": pa.array([d for d, _ in said], pa.int32()),
                "lang": pa.array([own.column("lang")[0].as_py()] * len(said) if said else [], pa.string()),
                "length": pa.array([n for _, n in said], pa.int32()),
                "phrases": pa.array(["\n".join(p) for p, _ in said.values()], pa.string()),
                "counts": pa.array([c for _, c in said.values()], pa.list_(pa.int64())),
            }
        )

    def add(dealt: pa.Table) -> pa.Table:
        sums: dict[tuple[str, int], Counter] = defaultdict(Counter)
        for batch in dealt.to_batches():
            for x in batch.to_pylist():
                of = sums[x["lang"], x["length"]]
                for phrase, c in zip(x["phrases"].split("\n"), x["counts"]):
                    of[phrase] += c
        rows = [(lang, phrase, n, c) for (lang, n), of in sums.items() for phrase, c in of.items() if c >= threshold]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int64()))], names=["lang", "phrase", "length", "f"])

    own = blocks.select("block", "lang", "size", "codes", "words")
    found = kept_hashes.withColumnRenamed("block", "of")
    made = own.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(trimmed(count), "deal int, lang string, length int, phrases string, counts array<long>")
    return written(made.groupBy("deal").applyInArrow(trimmed(add), "lang string, phrase string, length int, f long"), "phrases")


def best_phrases(phrases: DataFrame, totals: DataFrame, top: int, covered: int) -> DataFrame:
    """The first ``top`` phrases of two words or more of each lang: lang, rank, phrase, a, l, r, n, score.

    phrases: (lang, phrase, length, f), with every part of each phrase; totals: (lang, n). A phrase inside a longer one
    that has ``covered`` percent of its occurrences or more is left out.
    """
    long = phrases.where("length > 1").select("lang", "phrase", F.col("f").alias("a"), "length", F.split("phrase", " ").alias("w"))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    cuts = long.select("lang", "phrase", "a", "length", "w", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("length") - F.col("k")).alias("right"))
    known = lambda side, name: phrases.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"]).join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(38,0)) * cast(a as decimal(38,0)) * cast(n as decimal(38,0))) div (cast(l as decimal(38,0)) * cast(r as decimal(38,0)))")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    inner = long.where("length > 2").select("lang", "a", "w", "length", F.explode(F.sequence(F.lit(2), F.col("length") - 1)).alias("m"))
    inner = inner.select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("length") - F.col("m") + 1)).alias("at"))
    inner = inner.select("lang", part(F.col("at"), F.col("m")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    free = best.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("most") < covered * F.col("a"), F.lit(True)))
    free = free.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each share of a language first, so that no task sorts a whole one
    share = F.pmod(F.xxhash64("phrase"), F.lit(parts(phrases.sparkSession)))
    few = free.withColumn("s", share).withColumn("rank", F.row_number().over(W.partitionBy("lang", "s").orderBy(*order))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, threshold: int = 100, longest: int = 5, top: int = 2000, covered: int = 100) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of 2 to ``longest`` words of each language.

    Words are split at blanks and tabs inside pieces between ``.,;:!?`` and line ends, with A-Z lower-cased. n: words;
    a: occurrences, ``threshold`` or more; l, r: those of the two parts at the cut with the lowest score
    floor(1000 a n / (l r)), the first of equal ones. Scores are computed in 38 decimal digits. Null texts are empty;
    a null lang is ``und``, together with texts of that name; repeated rows count each; equal scores are ranked by a and
    then by the phrase's bytes. doc_id and other columns are not read. An empty table gives none.
    """
    blocks = word_blocks(docs)
    totals = blocks.groupBy("lang").agg(F.sum("n").alias("n"))
    return best_phrases(frequent_phrases(blocks, threshold, longest), totals, top, covered)
