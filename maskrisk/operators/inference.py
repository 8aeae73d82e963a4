"""Paired cluster bootstrap as integer weights, tail areas, Holm adjustment, and verdicts over conditions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.scores import count_if, hash_seed, hash_unit, mix32
from ..functions.shared import shipped, written
from .ranks import equal_bins, places
from .selective import TERMS, aurc, harmonics


#: Distinct rows of one stretch of scores, and replicates of one task.
STRETCH, BLOCK = 1 << 23, 1000
#: Stretches of a condition at most; longer conditions have longer stretches.
STRETCHES = 1024
#: Draws that are hashed at a time, and partitions over which tasks are dealt.
DRAWS, TASKS = 1 << 15, 256
#: Draws of many clusters that are hashed at a time: all whose numbers differ in the lower 16 bits alone.
LOW = 1 << 16
#: Draws that are sorted at a time where the classes of more clusters than CACHED, or their counts, are beyond a cache.
SORTED, CACHED = 1 << 19, 1 << 20
#: Records of a cluster beyond which it is a class of its own, and bytes of a row of packed arrays.
LONGEST, PIECE = 64, 1 << 22
#: Harmonic sums that a task looks up; larger ones are computed.
HARMONICS = 1 << 22


def numbered_clusters(rows: DataFrame, cond: list[str], cluster: str, seed: Column) -> DataFrame:
    """(cond, cluster, i, m, seed): the number of each cluster from 0, and how many its condition has."""
    c = places(rows.select(*cond, cluster).distinct(), cond, [cluster], "i", "m")
    return c.withColumns({"i": F.col("i") - 1, "seed": seed.cast("long")})


def cluster_weights(rows: DataFrame, cond: list[str], cluster: str, resamples: int, seed: Column) -> DataFrame:
    """(cond, cluster, rep, weight): how often each cluster is drawn in each replicate; undrawn ones are absent.

    Draw i of replicate b takes the cluster whose number is the hash of (seed, b, i) scaled to the number of clusters.
    """
    c = numbered_clusters(rows, cond, cluster, seed)
    keys = c.select(*cond, "m", "seed").distinct().withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    keys = keys.withColumn("k", mix32(mix32(F.col("rep").cast("long").bitwiseXOR(F.col("seed"))))).withColumn("l", mix32(F.col("k").bitwiseXOR(0x9E3779B9)))
    draws = keys.join(c.select(*cond, "i"), cond).withColumn("h", mix32(F.col("i").cast("long").bitwiseXOR(F.col("k"))))
    draws = draws.withColumn("h", mix32((F.col("h") + F.col("l")).bitwiseAND(0xFFFFFFFF)))
    picked = draws.groupBy(*cond, "rep", F.shiftright(F.col("h") * F.col("m"), 32).cast("int").alias("i")).agg(F.count("*").alias("weight"))
    return picked.join(c.select(*cond, "i", cluster), [*cond, "i"]).select(*cond, cluster, "rep", "weight")


def _mix32(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> 16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> 13
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> 16
    return x


def drawn(seed: int, clusters: int, reps: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows, places): draws of ``cluster_weights`` for some of ``reps``, as many at a time as stay in a cache."""
    k = _mix32(_mix32(reps.astype(np.uint32) ^ np.uint32(seed)))[:, None]
    l = _mix32(k ^ np.uint32(0x9E3779B9))  # noqa: E741
    i, m, shift = np.arange(min(DRAWS, clusters), dtype=np.uint32), np.uint64(clusters), np.uint64(32)
    step = max(1, DRAWS // clusters)
    for row in range(0, len(reps), step):
        rows = slice(row, min(row + step, len(reps)))
        for at in range(0, clusters, DRAWS):
            h = _mix32((i[: clusters - at] + np.uint32(at)) ^ k[rows])
            h += l[rows]
            wide = _mix32(h).astype(np.uint64)
            wide *= m
            wide >>= shift
            yield rows, wide.view(np.int64)


def counted(seed: int, clusters: int, reps: np.ndarray, of: np.ndarray | None = None, classes: int = 0) -> Iterator[np.ndarray]:
    """For each of ``reps`` how many of the draws of ``cluster_weights`` fall on each class, where ``of`` has that of each cluster; without it on each cluster."""
    classes = clusters if of is None else classes
    if clusters <= DRAWS:
        for _, picks in drawn(seed, clusters, reps):
            n = len(picks)
            at = (picks if of is None else of[picks]) + np.arange(n)[:, None] * classes
            yield from np.bincount(at.ravel(), minlength=n * classes).reshape(n, classes)
        return
    # Counts do not depend on the order of draws. The numbers of a whole block are h << 16 | y for all y < LOW in some
    # order, after the key and the first step of the hash too, so its first product is that of y, looked up, plus one
    # number. Blocks stay in a cache, and steps write in place. Sorted draws read the classes one behind the other.
    one, two = np.array(0x85EBCA6B, np.uint32), np.array(0xC2B2AE35, np.uint32)
    s13, s16, s32, m = np.array(13, np.uint32), np.array(16, np.uint32), np.array(32, np.uint64), np.array(clusters, np.uint64)
    low = np.arange(LOW, dtype=np.uint32)
    product = low * one
    piece = SORTED if of is None or clusters > CACHED else LOW
    hashes, spare, wide = np.empty(min(piece, clusters), np.uint32), np.empty(LOW, np.uint32), np.empty(LOW, np.uint64)
    few = of is not None and classes <= LOW
    found = np.empty(LOW if few else clusters, np.int64 if of is None else of.dtype)

    def hashed(at: int, x: np.ndarray, k: int, l: np.ndarray) -> None:  # noqa: E741
        t = spare[: len(x)]
        if len(x) == LOW:
            np.add(product, np.array((((at ^ k) >> 16 << 16) * 0x85EBCA6B) & 0xFFFFFFFF, np.uint32), x)
        else:
            np.bitwise_xor(low[: len(x)], np.array(at ^ k, np.uint32), x)
            np.right_shift(x, s16, t)
            np.bitwise_xor(x, t, x)
            np.multiply(x, one, x)
        np.right_shift(x, s13, t)
        np.bitwise_xor(x, t, x)
        np.multiply(x, two, x)
        np.right_shift(x, s16, t)
        np.bitwise_xor(x, t, x)
        np.add(x, l, x)
        for factor, shift in ((one, s16), (two, s13)):
            np.right_shift(x, shift, t)
            np.bitwise_xor(x, t, x)
            np.multiply(x, factor, x)
        np.right_shift(x, s16, t)
        np.bitwise_xor(x, t, x)

    keys = _mix32(_mix32(reps.astype(np.uint32) ^ np.uint32(seed)))
    for k, l in zip(keys.tolist(), _mix32(keys ^ np.uint32(0x9E3779B9))):
        counts, added = np.zeros(classes, np.int64), np.array(l)
        for start in range(0, clusters, piece):
            some = hashes[: clusters - start]
            for at in range(0, len(some), LOW):
                hashed(start + at, some[at : at + LOW], k, added)
            if piece > LOW:
                some.sort()
            for at in range(0, len(some), LOW):
                n = len(some[at : at + LOW])
                wide[:n] = some[at : at + LOW]
                np.multiply(wide[:n], m, wide[:n])
                np.right_shift(wide[:n], s32, wide[:n])
                picks, into = wide[:n].view(np.int64), found[:n] if few else found[start + at : start + at + n]
                if of is None:
                    into[:] = picks
                else:
                    of.take(picks, out=into, mode="clip")
                if few:
                    counts += np.bincount(into, minlength=classes)
        yield counts if few else np.bincount(found, minlength=classes)


def drawn_weights(seed: int, clusters: int, reps: np.ndarray) -> np.ndarray:
    """The weights of ``cluster_weights`` as a matrix, a row for each replicate and a column for each cluster."""
    return np.array(list(counted(seed, clusters, reps)), np.int32).reshape(len(reps), clusters)


class Kinds:
    """Rows that agree in all ``values`` as one kind; drawn rows are summed over kinds once, for both sides."""

    def __init__(self, values: list[np.ndarray], i: np.ndarray, copies: np.ndarray):
        order = np.lexsort(values)
        new = np.ones(len(i), bool)
        if len(i):
            new[1:] = False
        for v in values:
            v = v[order]
            new[1:] |= (v[1:] != v[:-1]) & ~((v[1:] != v[1:]) & (v[:-1] != v[:-1]))
        of = np.empty(len(i), np.int32)
        of[order] = np.cumsum(new) - 1
        by = np.lexsort((of, i))  # weights are then read one behind the other
        self.first, self.i, self.kind = order[new], i[by], of[by]
        self.copies = copies[by] if copies.max(initial=1) > 1 else None

    @classmethod
    def of(cls, i: np.ndarray, kind: np.ndarray, copies: np.ndarray | None, kinds: int) -> Kinds:
        """Of arrays that another one has worked out."""
        self = cls.__new__(cls)
        self.i, self.kind, self.copies, self.first = i, kind, copies, np.arange(kinds)
        return self

    def classed(self, clusters: int) -> tuple[np.ndarray, int]:
        """The class of each cluster and how many there are; from then on ``weights`` takes the draws of each class.

        Clusters of the same kinds in the same numbers of copies are one class, and those without a row are class 0.
        """
        starts = np.flatnonzero(np.r_[True, self.i[1:] != self.i[:-1]])
        lengths = np.diff(np.r_[starts, len(self.i)])
        pair = self.kind.astype(np.int64)
        if self.copies is not None:
            pair = np.unique(pair * (int(self.copies.max()) + 1) + self.copies, return_inverse=True)[1]
        base, own, new, long = int(pair.max()) + 1, np.zeros(len(starts), np.int64), 1, lengths > LONGEST
        for j in range(min(int(lengths.max()), LONGEST)):  # a number for each sequence of the first j + 1
            on = np.flatnonzero((lengths > j) & ~long)
            found, at = np.unique(own[on] * base + pair[starts[on] + j], return_inverse=True)
            own[on] = new + at
            new += len(found)
        own[long] = new + np.arange(long.sum())
        found, first, at = np.unique(own, return_index=True, return_inverse=True)
        classes = len(found) + 1
        of = np.zeros(clusters, np.uint16 if classes <= LOW else np.int32)
        of[self.i[starts]] = at + 1
        n = lengths[first]
        rows = np.repeat(starts[first] - np.cumsum(n) + n, n) + np.arange(n.sum())
        self.i, self.kind = np.repeat(np.arange(1, classes, dtype=np.int32), n), self.kind[rows]
        self.copies = None if self.copies is None else self.copies[rows]
        return of, classes

    def weights(self, clusters: np.ndarray) -> np.ndarray:
        """The weight of each kind where clusters (or classes) have these weights; whole numbers below 2^53."""
        w = clusters[self.i]
        return np.bincount(self.kind, w if self.copies is None else w * self.copies, len(self.first))


class Ties:
    """Kinds of one side of a stretch in the order of their scores, the largest first and missing ones last."""

    def __init__(self, score: np.ndarray, risk: np.ndarray, kind: np.ndarray):
        order = np.argsort(-score, kind="stable")
        score, self.risk, self.kind = score[order], risk[order], kind[order]
        new = np.ones(len(score), bool)
        new[1:] = (score[1:] != score[:-1]) & ~(np.isnan(score[1:]) & np.isnan(score[:-1]))
        self.starts = np.flatnonzero(new)

    def sums(self, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weight and risk of each distinct score, where kinds have ``weights``."""
        g = weights[self.kind]
        return np.add.reduceat(g, self.starts).astype(np.int64), np.add.reduceat(g * self.risk, self.starts)


def bootstrap_differences(rows: DataFrame, cond: list[str], left: str, right: str, risk: str, cluster: str, resamples: int, seed: Column) -> DataFrame:
    """Areas of two scores and their difference for each replicate; both use the same drawn rows.

    The two scores are two sides of one table. Records that agree in cluster, scores and risk are counted first. Each
    side of a condition is cut into stretches of its scores, and one task packs a stretch of both sides into arrays:
    clusters whose records agree are one class. Tasks take these arrays and a block of replicates: they hash the draws
    and count how many fall on each class, once for both sides, so that neither weights nor records are sent for each
    block, and give sums for each replicate. So the time is that of one hash and one look-up for each replicate and
    cluster. Where a condition has several stretches, a first pass gives the totals of each, and the areas start from
    those before it. A task holds a stretch and one replicate's draws, so clusters of a condition must fit in a task as
    integers. Null and NaN scores come last, as one tie; null risks count as 0; an empty table gives no
    rows. Rows are written once, as several parts read them.
    """
    return differences(drawn_rows(rows, cond, left, right, risk, cluster), cond, left, right, risk, cluster, resamples, seed)


def drawn_rows(rows: DataFrame, cond: list[str], left: str, right: str, risk: str, cluster: str) -> DataFrame:
    """The columns of a bootstrap, written once."""
    return written(rows.select(*dict.fromkeys([*cond, cluster, left, right, risk])), "drawn")


def stretches(each: DataFrame, rows: DataFrame, sizes: DataFrame, cond: list[str]) -> DataFrame:
    """``each`` with left_at and right_at, the stretch of each side that a row is in, and a row for each of them; ``parts`` of its condition."""
    cuts = []
    for side in ("left", "right"):
        # Distinct ends are scores of the side; a stretch that only one side has is empty on the other.
        long = rows.join(sizes.where("parts > 1"), cond).groupBy(*cond).agg(F.percentile_approx(side, [k / STRETCHES for k in range(1, STRETCHES)], 4 * STRETCHES).alias("ends"))
        cuts.append(long.withColumnRenamed("ends", f"{side}_ends"))
    ends = sizes.join(cuts[0], cond, "left").join(cuts[1], cond, "left")
    for side in ("left", "right"):
        chosen = F.expr(f"array_distinct(transform(filter(sequence(1, parts), k -> k < parts), k -> {side}_ends[CAST(k * {STRETCHES} div parts AS INT) - 1]))")
        ends = ends.withColumn(f"{side}_ends", F.when(F.col(f"{side}_ends").isNull(), F.array().cast("array<double>")).otherwise(chosen))
    each = each.join(ends.withColumn("parts", F.greatest(F.size("left_ends"), F.size("right_ends")) + 1), cond)
    for side in ("left", "right"):
        above = F.size(F.filter(f"{side}_ends", lambda e: e > F.col(side)))  # 0 for the stretch of the largest scores
        each = each.withColumn(f"{side}_at", F.when(F.col(side).isNull(), F.size(f"{side}_ends")).otherwise(above))
    return each.withColumn("stretch", F.explode(F.array_distinct(F.array("left_at", "right_at")))).drop("left_ends", "right_ends")


def differences(rows: DataFrame, cond: list[str], left: str, right: str, risk: str, cluster: str, resamples: int, seed: Column) -> DataFrame:
    """``bootstrap_differences`` of a written table."""
    whole = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    rows = shipped(rows).select(*cond, cluster, whole(left).alias("left"), whole(right).alias("right"), F.coalesce(F.col(risk).cast("double"), F.lit(0.0)).alias("risk"))
    each = rows.groupBy(*cond, cluster, "left", "right", "risk").agg(F.count("*").cast("int").alias("copies"))
    sizes = rows.groupBy(*cond).agg(F.least(F.lit(STRETCHES), F.ceil(F.count("*") / STRETCH)).cast("int").alias("parts"))
    several = not sizes.where("parts > 1").isEmpty()
    zero = F.lit(0)
    each = stretches(each, rows, sizes, cond) if several else each.withColumns({"parts": F.lit(1), "left_at": zero, "right_at": zero, "stretch": zero})
    each = each.join(numbered_clusters(rows, cond, cluster, seed), [*cond, cluster])
    in_left, in_right = F.col("left_at") == F.col("stretch"), F.col("right_at") == F.col("stretch")
    each = each.select(*cond, "stretch", "parts", "left", "right", in_left.alias("in_left"), in_right.alias("in_right"), "risk", "copies", F.col("i").cast("int").alias("i"), F.col("m").cast("int").alias("m"), "seed")
    size = min(BLOCK, resamples)
    task = [*cond, "stretch", "block"]
    fields = [rows.schema[c] for c in cond]
    number = {"side": T.IntegerType(), "stretch": T.IntegerType(), "rep": T.IntegerType(), "g": T.DoubleType(), "s": T.DoubleType(), "step": T.DoubleType()}
    first = T.StructType([*fields, *(T.StructField(n, number[n]) for n in ("side", "stretch", "rep", "g", "s"))])
    last = T.StructType([*fields, *(T.StructField(n, number[n]) for n in ("side", "rep", "step", "g"))])
    array = {"stretch": T.IntegerType(), "parts": T.IntegerType(), "name": T.StringType(), "type": T.StringType(), "piece": T.IntegerType(), "data": T.BinaryType()}
    packed = T.StructType([*fields, *(T.StructField(n, t) for n, t in array.items())])
    packed_arrow = to_arrow_schema(packed)

    def pack(key: tuple, f: pa.Table) -> pa.Table:
        """The arrays of a stretch, in rows of PIECE bytes: what its tasks would otherwise work out for each block."""
        get = lambda c, t: f.column(c).to_numpy().astype(t)
        values = [get(c, t) for c, t in (("in_left", bool), ("in_right", bool), ("risk", float), ("left", float), ("right", float))]
        i, copies, m = get("i", np.int32), get("copies", np.int64), f.column("m")[0].as_py()
        kinds = Kinds(values, i, copies)
        plain = kinds.i, kinds.kind, kinds.copies
        of, classes = kinds.classed(m)
        if classes > LOW or 2 * classes > m:  # draws are then counted for each cluster
            of, classes = None, m
            kinds.i, kinds.kind, kinds.copies = plain
        arrays = {"about": np.array([f.column("seed")[0].as_py(), m, classes, copies.sum()]), "i": kinds.i, "kind": kinds.kind, "copies": kinds.copies, "of": of}
        arrays |= dict(zip(("in_left", "in_right", "risk", "left", "right"), (v[kinds.first] for v in values)))
        cut = [(name, a.dtype.str, at // PIECE, a.tobytes()[at : at + PIECE]) for name, a in arrays.items() if a is not None for at in range(0, a.nbytes, PIECE)]
        named = {**{c: pa.repeat(k, len(cut)) for c, k in zip(cond, key)}, "stretch": pa.repeat(key[-1], len(cut)), "parts": pa.repeat(f.column("parts")[0], len(cut))}
        named |= {c: pa.array(v) for c, v in zip(("name", "type", "piece", "data"), zip(*cut))}
        return pa.table({c: named[c] for c in packed.names}).cast(packed_arrow)

    def unpacked(f: pa.Table) -> dict[str, np.ndarray]:
        parts: dict[tuple, list] = {}
        for name, kind, _, data in sorted(zip(*(f.column(c).to_pylist() for c in ("name", "type", "piece", "data"))), key=lambda x: x[:3]):
            parts.setdefault((name, kind), []).append(data)
        return {name: np.frombuffer(b"".join(data), kind) for (name, kind), data in parts.items()}

    def framed(key: tuple, schema: T.StructType, side: int, reps: np.ndarray, **values) -> pa.Table:
        n = len(reps)
        named = {**{c: pa.repeat(k, n) for c, k in zip(cond, key)}, "side": pa.repeat(side, n), "stretch": pa.repeat(key[-2], n), "rep": reps, **values}
        return pa.table({f.name: pa.array(named[f.name]) for f in schema})

    def by_side(arrays: dict[str, np.ndarray], block: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(side, rep, weight and risk of each distinct score); the weights of a replicate are drawn once for both sides."""
        seed, m, classes, _ = arrays["about"].tolist()
        kinds, at = Kinds.of(arrays["i"], arrays["kind"], arrays.get("copies"), len(arrays["risk"])), np.arange(len(arrays["risk"]), dtype=np.int32)
        sides = [Ties(arrays[side][on], arrays["risk"][on], at[on]) for side, on in (("left", arrays["in_left"]), ("right", arrays["in_right"]))]
        reps = np.arange(block * size, min((block + 1) * size, resamples))
        for rep, counts in zip(reps.tolist(), counted(seed, m, reps, arrays.get("of"), classes)):
            weights = kinds.weights(counts.astype(float))
            for side, ties in enumerate(sides):
                if len(ties.starts):
                    yield side, rep, *ties.sums(weights)

    def gathered(key: tuple, schema: T.StructType, found: Iterator[tuple]) -> pa.Table:
        names = schema.names[-2:]
        rows = list(found)
        parts = []
        for side in (0, 1):
            own = np.array([r[1:] for r in rows if r[0] == side]).reshape(-1, 3)
            parts.append(framed(key, schema, side, own[:, 0].astype(np.int32), **{n: own[:, k + 1] for k, n in enumerate(names)}))
        return pa.concat_tables([p.cast(first_arrow if schema is first else last_arrow) for p in parts])

    first_arrow, last_arrow = to_arrow_schema(first), to_arrow_schema(last)

    def totals(key: tuple, f: pa.Table) -> pa.Table:
        key = tuple(k.as_py() for k in key)
        return gathered(key, first, ((side, rep, g.sum(), s.sum()) for side, rep, g, s in by_side(unpacked(f), key[-1])))

    def areas(key: tuple, mine: pa.Table, before: pa.Table) -> pa.Table:
        key = tuple(k.as_py() for k in key)
        past = {(a, b): (g, s) for a, b, g, s in zip(*(before.column(c).to_pylist() for c in ("side", "rep", "g", "s")))}

        arrays = unpacked(mine)
        known = harmonics(np.arange(min(HARMONICS, 2 * int(arrays["about"][-1]) + TERMS))) if arrays else None

        def steps() -> Iterator[tuple]:
            for side, rep, g, s in by_side(arrays, key[-1]) if arrays else ():
                g0, s0 = past.get((side, rep), (0.0, 0.0))
                on = g > 0
                g, s = g[on], s[on]
                full = np.cumsum(g)
                prior = full - g + int(g0)
                at = np.r_[int(g0), full + int(g0)]
                step = s + (np.cumsum(s) - s + s0 - prior * s / g) * np.diff(known[at] if at[-1] < len(known) else harmonics(at))
                yield side, rep, step.sum(), g.sum()

        return gathered(key, last, steps())

    each = each.groupBy(*cond, "stretch").applyInArrow(pack, packed)
    each = written(each, "packed") if several else each
    each = each.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // size))))
    dealt = each.repartition(TASKS, *task)
    if several:
        many = each.where("stretch < parts - 1").repartition(TASKS, *task).groupBy(*task).applyInArrow(totals, first)
        past = W.partitionBy(*cond, "side", "rep").orderBy("stretch").rowsBetween(W.unboundedPreceding, 0)
        before = many.select(*cond, "side", (F.col("stretch") + 1).alias("stretch"), "rep", F.sum("g").over(past).alias("g"), F.sum("s").over(past).alias("s"))
        before = before.withColumn("block", (F.floor(F.col("rep") / size)).cast("int"))
        got = dealt.groupBy(*task).cogroup(before.groupBy(*task)).applyInArrow(areas, last)
    else:
        nothing = first_arrow.empty_table()
        got = dealt.groupBy(*task).applyInArrow(lambda key, mine: areas(key, mine, nothing), last)
    share = got.groupBy(*cond, "rep", "side").agg((F.sum("step") / F.sum("g")).alias("aurc"))
    a = share.groupBy(*cond, "rep").agg(F.max(F.when(F.col("side") == 0, F.col("aurc"))).alias("left"), F.max(F.when(F.col("side") == 1, F.col("aurc"))).alias("right"))
    return a.withColumn("difference", F.col("left") - F.col("right"))


def contrast(rows: DataFrame, cond: list[str], left: str, right: str, risk: str, cluster: str, resamples: int = 10_000, level: float = 0.95, seed: Column | None = None) -> DataFrame:
    """The paired difference of areas, its percentile interval and two-sided tail area for each condition."""
    seed = hash_seed(F.lit("0"), *[F.col(c) for c in cond], F.lit(left), F.lit(right), F.lit(risk)) if seed is None else seed
    rows = drawn_rows(rows, cond, left, right, risk, cluster)
    d = differences(rows, cond, left, right, risk, cluster, resamples, seed)
    tail = (1 - level) / 2
    b = d.groupBy(*cond).agg(F.percentile("difference", F.lit(tail)).alias("low"), F.percentile("difference", F.lit(1 - tail)).alias("high"), tail_area(F.col("difference")).alias("p_value"))
    own = aurc(rows, cond, left, risk).select(*cond, F.col("aurc").alias("_l")).join(aurc(rows, cond, right, risk).select(*cond, F.col("aurc").alias("_r")), cond)
    return own.select(*cond, (F.col("_l") - F.col("_r")).alias("difference")).join(b, cond)


def tail_area(difference: Column) -> Column:
    """min(1, 2 min((1 + #<=0) / (B + 1), (1 + #>=0) / (B + 1))) over replicates."""
    b = F.count("*") + 1
    return F.least(F.lit(1.0), 2 * F.least((1 + count_if(difference <= 0)) / b, (1 + count_if(difference >= 0)) / b))


def holm(rows: DataFrame, family: list[str], p: str = "p_value", tie: str = "name") -> DataFrame:
    """``rows`` with adjusted: Holm's step-down values within each family."""
    w = W.partitionBy(*family).orderBy(p, tie)
    step = F.col(p) * (F.count("*").over(W.partitionBy(*family)) - F.row_number().over(w) + 1)
    up = w.rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("_step", step).withColumn("adjusted", F.least(F.lit(1.0), F.max("_step").over(up))).drop("_step")


def equal_count_reliability(rows: DataFrame, cond: list[str], predicted: str, observed: str, tie: str, resamples: int, bins: int = 10, level: float = 0.95, seed: int = 0) -> DataFrame:
    """Ten bins of about equal count with an interval for each observed mean by drawing rows within the bin.

    Tasks take a bin and a block of replicates, draw the rows' weights from hashes and give one mean for each replicate:
    neither weights nor drawn rows are sent. A task holds the observed values of its bin.
    """
    b = equal_bins(rows.select(*cond, *{predicted: 0, observed: 0, tie: 0}), cond, [predicted, tie], bins)
    group = [*cond, "bin"]
    b = b.select(*group, F.col(predicted).alias("p"), F.col(observed).cast("double").alias("o"), (F.row_number().over(W.partitionBy(*group).orderBy(predicted, tie)) - 1).alias("i"))
    size = min(BLOCK, resamples)
    each = b.select(*group, "i", "o", hash_seed(F.lit(str(seed)), *[F.col(c) for c in group]).cast("long").alias("seed"), F.explode(F.sequence(F.lit(0), F.lit((resamples - 1) // size))).alias("block"))
    schema = T.StructType([*(b.schema[c] for c in group), T.StructField("rep", T.IntegerType()), T.StructField("mean", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def means_of(key: tuple, f: pa.Table) -> pa.Table:
        values, m, block = np.empty(len(f)), len(f), key[-1].as_py()
        values[f.column("i").to_numpy()] = f.column("o").to_numpy()  # a missing value makes its means missing
        reps = np.arange(block * size, min((block + 1) * size, resamples), dtype=np.int32)
        mean = np.zeros(len(reps))
        for rows, picks in drawn(f.column("seed")[0].as_py(), m, reps):
            mean[rows] += values[picks].sum(axis=1)
        named = {**{c: pa.repeat(k, len(reps)) for c, k in zip(group, key)}, "rep": reps, "mean": mean / m}
        return pa.table({c: pa.array(x) for c, x in named.items()}).cast(arrow)

    means = shipped(each).repartition(TASKS, *group, "block").groupBy(*group, "block").applyInArrow(means_of, schema)
    tail = (1 - level) / 2
    ci = means.groupBy(*group).agg(F.percentile("mean", F.lit(tail)).alias("low"), F.percentile("mean", F.lit(1 - tail)).alias("high"))
    own = b.groupBy(*group).agg(F.count("*").alias("n"), F.avg("p").alias("mean_predicted"), F.min("p").alias("least_predicted"), F.max("p").alias("largest_predicted"), F.avg("o").alias("mean_observed"))
    return own.join(ci, group)


def percent_margin(rows: DataFrame, cond: list[str], base: str, rival: str, risk: str, cluster: str, resamples: int, level: float = 0.95, seed: Column | None = None) -> DataFrame:
    """100 (base - rival) / base of the areas, with its percentile interval."""
    seed = F.lit(0) if seed is None else seed
    rows = drawn_rows(rows, cond, base, rival, risk, cluster)
    d = differences(rows, cond, base, rival, risk, cluster, resamples, seed)
    tail = (1 - level) / 2
    m = 100 * F.col("difference") / F.col("left")
    ci = d.groupBy(*cond).agg(F.percentile(m, F.lit(tail)).alias("low"), F.percentile(m, F.lit(1 - tail)).alias("high"))
    own = aurc(rows, cond, base, risk).select(*cond, F.col("aurc").alias("a")).join(aurc(rows, cond, rival, risk).select(*cond, F.col("aurc").alias("b")), cond)
    return own.select(*cond, (100 * (F.col("a") - F.col("b")) / F.col("a")).alias("margin")).join(ci, cond)


def gate(rows: DataFrame, group: list[str], difference: str = "difference") -> DataFrame:
    """Wins (below 0), losses, ties over conditions, mean and median difference, and whether the left side passes."""
    d = F.col(difference)
    g = rows.groupBy(*group).agg(count_if(d < 0).alias("wins"), count_if(d > 0).alias("losses"), count_if(d == 0).alias("ties"), F.avg(d).alias("mean_difference"), F.percentile(d, F.lit(0.5)).alias("median_difference"))
    return g.withColumn("passes", ((F.col("wins") > F.col("losses")) & (F.col("mean_difference") < 0)).cast("int"))
