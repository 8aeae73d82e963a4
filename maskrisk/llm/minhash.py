"""Document fingerprints by one-permutation MinHash, kept as packed low-order bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import parts
from .quality_rules import let, words_of

#: Words of a shingle; bins of a fingerprint; bits kept of each bin's smallest hash.
SHINGLE, BINS, BITS = 5, 256, 4
#: The upper bits of a hash name its bin; the lower ones are its value there, and all ones stand for an empty bin.
SHIFT = 56
EMPTY = (1 << SHIFT) - 1
PER_LONG = 64 // BITS
#: Text bytes of a range of doc_ids, about, and ids sampled for each range.
RANGE_BYTES, SAMPLE = 64 << 20, 40
#: Attempts at filling a bin, in steps between which a fingerprint without empty bins is done.
ATTEMPTS = ((1, 8), (9, 32), (33, BINS))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def mixed(x: int) -> int:
    """A fixed 64-bit mix of a small number."""
    x = (x + 0x9E3779B97F4A7C15) & (2**64 - 1)
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & (2**64 - 1)
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & (2**64 - 1)
    return x ^ (x >> 31)


def longs(values) -> Column:
    return F.expr("array(" + ",".join(f"{v}L" for v in values) + ")")


def probe(bin_: int, attempt: int) -> int:
    """The bin that an empty bin asks at an attempt: a start and an odd stride of its own, so all are asked in the end."""
    return (mixed(2 * bin_) + attempt * (mixed(2 * bin_ + 1) | 1)) % BINS


def densified(bins: Column) -> Column:
    """Every empty bin takes the value of the first full bin that its own sequence of probes meets."""
    start = longs(mixed(2 * i) % BINS for i in range(BINS))
    stride = longs((mixed(2 * i + 1) | 1) % BINS for i in range(BINS))

    def body(own: Column) -> Column:
        def attempt(acc: Column, t: Column) -> Column:
            def fill(v: Column, i: Column) -> Column:
                at = (F.get(start, i) + t * F.get(stride, i)).bitwiseAND(F.lit(BINS - 1))
                return F.when(v == EMPTY, F.get(own, at.cast("int"))).otherwise(v)

            return F.when(F.array_contains(acc, F.lit(EMPTY)), F.transform(acc, fill)).otherwise(acc)

        def tried(first: int, last: int):
            def some(acc: Column) -> Column:
                all_ = F.aggregate(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long")), acc, attempt)
                return F.when(F.array_contains(acc, F.lit(EMPTY)), all_).otherwise(acc)

            return some

        out = own
        for first, last in ATTEMPTS:
            out = let(out, tried(first, last))
        return out

    return let(bins, body)


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a whole text, an array of longs; zeros for a text without a word.

    Shingles of five words, fewer words as one, are hashed once. Each bin's smallest value is the first of the bin in
    sorted order; a closing value for each bin, sorted in with the hashes, makes every bin appear.
    """
    closing = longs(signed((b << SHIFT) | EMPTY) for b in range(BINS))

    def hashes(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - (SHINGLE - 1)), lambda i: F.xxhash64(F.slice(w, i, SHINGLE)))
        return F.when(F.size(w) < SHINGLE, F.array(F.xxhash64(w))).otherwise(windows)

    def smallest(s: Column) -> Column:
        top = lambda x: F.shiftrightunsigned(x, SHIFT)
        firsts = F.filter(s, lambda x, i: (i == 0) | (top(x) != top(F.get(s, i - 1))))
        return F.transform(firsts, lambda x: x.bitwiseAND(F.lit(EMPTY)))

    def packed(v: Column) -> Column:
        def one(g: Column) -> Column:
            return F.aggregate(F.slice(v, g * PER_LONG + 1, PER_LONG), F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, BITS).bitwiseOR(x.bitwiseAND(F.lit((1 << BITS) - 1))))

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), one)

    def body(w: Column) -> Column:
        full = let(F.sort_array(F.concat(hashes(w), closing)), smallest)
        return F.when(F.size(w) == 0, longs([0] * (BINS // PER_LONG))).otherwise(let(densified(full), packed))

    return let(words_of(text), body)


def as_text(fp: Column) -> Column:
    return F.array_join(F.transform(fp, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles: equal bins, less those that agree in ``BITS`` bits by chance; 0 to 1."""
    ones = F.lit(int("1".rjust(BITS, "0") * PER_LONG, 2))

    def unlike(x: Column) -> Column:
        folded = x
        for k in range(1, BITS):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, k))
        return F.bit_count(folded.bitwiseAND(ones))

    differ = F.aggregate(F.zip_with(a, b, lambda x, y: let(x.bitwiseXOR(y), unlike)), F.lit(0), lambda n, x: n + x)
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (1 - differ / F.lit(float(BINS)) - chance) / (1 - chance))


def range_of(key: Column, limits: list[int], step: int) -> Column:
    """How many of the sorted ``limits`` are at most ``key``: first among each ``step``-th, then in that stretch."""
    if not limits:
        return F.lit(0)
    every = longs(limits) if -(2**63) not in limits else F.array(*[F.lit(x) for x in limits])
    tops = longs(limits[step - 1 :: step]) if -(2**63) not in limits else F.array(*[F.lit(x) for x in limits[step - 1 :: step]])

    def within(c: Column) -> Column:
        return c * step + F.size(F.filter(F.slice(every, c * step + 1, F.lit(step)), lambda b: b <= key))

    return let(F.size(F.filter(tops, lambda b: b <= key)), within)


def with_next(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, text, fp and those of the next row by descending doc_id (after the last: the first): next_text, next_fp.

    Rows are dealt into ranges of doc_id with about equal counts, between splitters from a sample of ids. The first row of each range is copied behind the last
    of the range before it, so one shuffle brings every row to its next one and no range needs another. Only the
    ranges' bounds and first ids come to the driver. Rows of one id are ordered by a hash of their texts.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    count, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = buckets or max(2 * parts(spark), size // RANGE_BYTES)
    some = rows.select(key.alias("id")).sample(fraction=min(1.0, SAMPLE * n / max(count, 1)), seed=7)
    ids = sorted(r.id for r in some.collect())  # SAMPLE numbers for each range
    limits = sorted({ids[len(ids) * i // n] for i in range(1, n)}) if ids else []
    step = max(1, round(len(limits) ** 0.5))
    rows = rows.withColumn("bucket", range_of(key, limits, step))
    tops = rows.groupBy("bucket").agg(F.max(F.struct(key.alias("id"), "h")).alias("top")).collect()  # a row for each range
    tops = sorted(((r.bucket, r.top.id, r.top.h) for r in tops), reverse=True)
    own = rows.select("doc_id", "text", "h", "bucket", F.lit(0).alias("copy"))
    if tops:
        values = ",".join(f"({b},CAST({i} AS BIGINT),{h}L)" for b, (_, i, h) in zip([x[0] for x in tops], tops[1:] + tops[:1], strict=True)).replace(str(-(2**63)) + "L", "CAST(" + str(-(2**63)) + " AS BIGINT)")
        heads = spark.sql(f"SELECT * FROM VALUES {values} AS t(bucket, id, h)")
        keyed = rows.withColumn("id", key).drop("bucket")
        own = own.unionByName(keyed.join(F.broadcast(heads), ["id", "h"]).select("doc_id", "text", "h", "bucket", F.lit(1).alias("copy")))  # a row for each range
    w = W.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("h"))
    made = own.withColumn("fp", fingerprint(F.col("text")))
    return made.withColumn("next_text", F.lead("text").over(w)).withColumn("next_fp", F.lead("fp").over(w)).where("copy = 0").select("doc_id", "text", "fp", "next_text", "next_fp")


def fingerprint_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of ``docs``.

    The edited text has its last third replaced by the beginning of the next document's text. Null texts are empty;
    equal texts have equal fingerprints, and empty ones are alike only to empty ones; repeated rows stay rows, of which
    each is the next of the one before; a single row is its own next; an empty table gives an empty table.
    """
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), F.length("text") - third), F.substr("next_text", F.lit(1), third))
    made = with_next(docs, buckets).select("doc_id", F.length("text").cast("long").alias("n_chars"), "fp", "next_fp", edited.alias("edited"))
    made = made.select("doc_id", "n_chars", "fp", "next_fp", F.sha2("edited", 256).alias("edited_sha256"), fingerprint(F.col("edited")).alias("edited_fp"))
    return made.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("fp")).alias("fingerprint"), as_text(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
