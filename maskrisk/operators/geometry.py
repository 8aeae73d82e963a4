"""Surface distances of masks and of level sets: exact integer squared distances, one square root at the end.

A mask's surface is its pixels with a 4-neighbour outside the mask or outside the frame. For level sets one neighbour pass
serves all thresholds: with m the smallest of the four neighbours' values (0 outside the frame), a pixel is on the surface
of {p >= t} exactly if m < t <= p.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import shipped, written
from .images import WHOLE, by_size, per_image, shares

#: More than any distance within an image, and the bits of a squared distance within it.
FAR, REACH = 1 << 22, 42
#: Rows up to so many columns compare all their places at once; numbers that a task holds for that at a time, about.
NARROW, CELLS = 64, 1 << 20
#: More than any step within an image that a task holds.
FAR_WHOLE = 1 << 14


def with_neighbours(px: DataFrame, key: list[str], value: str) -> DataFrame:
    """``px`` with low: the smallest value of the four neighbours, 0 where one is outside the frame."""
    row, col = W.partitionBy(*key, "y").orderBy("x"), W.partitionBy(*key, "x").orderBy("y")
    near = [F.coalesce(f(value).over(w), F.lit(0)) for w in (row, col) for f in (F.lag, F.lead)]
    return px.withColumn("low", F.least(*near))


def surface(px: DataFrame, key: list[str], mask: str) -> DataFrame:
    """(key, y, x) of the surface pixels of a 0/1 column."""
    return with_neighbours(px, key, mask).where((F.col(mask) == 1) & (F.col("low") == 0)).select(*key, "y", "x")


def level_surfaces(px: DataFrame, key: list[str], nodes: list[float]) -> DataFrame:
    """(key, t, y, x) of the surface pixels of {p >= t} for each node t; a pixel is listed for its own interval only."""
    at = F.array(*[F.lit(float(t)) for t in nodes])
    n = with_neighbours(px, key, "p").where("low < p").select(*key, "y", "x", "p", "low")
    return n.select(*key, "y", "x", F.explode(F.filter(at, lambda t: (t > F.col("low")) & (t <= F.col("p")))).alias("t"))


def nearest(from_: DataFrame, to: DataFrame, key: list[str]) -> DataFrame:
    """d2 for each point of ``from_``: the squared distance to the nearest point of ``to`` with the same key.

    The separable distance transform. First along columns: each column of ``to`` gives its gap to every row that has
    points. Then along rows: a row's points look left and right over the gaps as long as a column can still be nearer.
    No more rows arise than images have pixels, and a task holds one row or column of an image.
    """
    rows = from_.groupBy(*key).agg(F.sort_array(F.collect_set("y")).alias("rows"))
    columns = to.groupBy(*key, F.col("x").alias("cx")).agg(F.sort_array(F.collect_list("y")).alias("ys")).join(rows, key)

    @F.pandas_udf("array<int>")
    def gaps(ys: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([steps_to(np.asarray(y), np.asarray(r)) for y, r in zip(ys, rows)], dtype=object)

    @F.pandas_udf("array<long>")
    def squares(cells: pd.DataFrame) -> pd.Series:
        found = []
        for xs, cx, gap in zip(cells["xs"], cells["cx"], cells["gap"]):
            cx, order = np.sort(np.asarray(cx)), np.argsort(np.asarray(cx))
            found.append(least_squares(cx, np.asarray(gap, np.int64)[order, None] ** 2, np.asarray(xs))[:, 0])
        return pd.Series(found, dtype=object)

    each = shipped(columns).select(*key, "cx", F.explode(F.arrays_zip("rows", gaps("ys", "rows").alias("gap"))).alias("e")).select(*key, "cx", F.col("e.rows").alias("y"), F.col("e.gap").alias("gap"))
    cells = each.groupBy(*key, "y").agg(F.collect_list(F.struct("cx", "gap")).alias("c"))
    points = from_.groupBy(*key, "y").agg(F.collect_list(F.struct("*")).alias("points"))
    both = points.join(cells, [*key, "y"]).select("points", squares(F.struct(F.col("points.x").alias("xs"), F.col("c.cx").alias("cx"), F.col("c.gap").alias("gap"))).alias("d2"))
    return both.select(F.explode(F.arrays_zip("points", "d2")).alias("e")).select("e.points.*", F.col("e.d2").alias("d2"))


def steps_to(ys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each of ``rows`` the distance to the nearest of the ascending ``ys``."""
    at = np.searchsorted(ys, rows)
    return np.minimum(np.abs(rows - ys[np.maximum(at - 1, 0)]), np.abs(ys[np.minimum(at, len(ys) - 1)] - rows)).astype(np.int32)


def least_squares(xs: np.ndarray, g2: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The smallest g2[i] + (xs[i] - a)^2 over i for each a of ``at`` and each column of g2; xs ascending and distinct."""
    xs, at = xs.astype(np.int64), at.astype(np.int64)
    mid = np.searchsorted(xs, at)
    out = np.full((len(at), g2.shape[1]), FAR * FAR, np.int64)
    some = np.flatnonzero(g2.min(0, initial=FAR * FAR) < FAR * FAR)
    best, g2 = out[:, some], g2[:, some]
    for step in range(len(xs) + 1):
        for i in (mid - 1 - step, mid + step):
            ok = np.flatnonzero((i >= 0) & (i < len(xs)))
            i = i[ok]
            best[ok] = np.minimum(best[ok], g2[i] + (xs[i] - at[ok])[:, None] ** 2)
        if step * step >= best.max(initial=0):
            break
    out[:, some] = best
    return out


def alike(batch: pa.RecordBatch, name: str) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray], pa.Array]]:
    """The lists of a batch by their places: the lists, their places, their numbers as (lists, places), and all gaps."""
    lists = batch.column("_c")
    starts, flat = lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten()
    where = flat.field(name).to_numpy()
    fields = [flat.field(n).to_numpy(zero_copy_only=False) for n in ("_v", "_low", "_s", *(["_gap"] if name == "x" else []))]
    gaps, same, most = flat.field("_gaps") if name == "x" else None, defaultdict(list), batch.column("_h").to_pylist() if name == "y" else [0] * batch.num_rows
    for n, (i, j) in enumerate(zip(starts[:-1], starts[1:])):
        same[most[n], where[i:j].tobytes()].append(n)
    for numbers in same.values():
        size = int(starts[numbers[0] + 1] - starts[numbers[0]])
        step = min(4096, max(1, CELLS // (64 * size)))
        for at in range(0, len(numbers), step):
            part = np.array(numbers[at : at + step])
            cells = starts[part][:, None] + np.arange(size)
            yield part, where[cells[0]], [f[cells] for f in fields], gaps.take(pa.array(cells.ravel())) if gaps is not None else None


def pooled_distances(px: DataFrame, key: list[str], value: str, fixed: str, nodes: list[float]) -> DataFrame:
    """(key, k, d2, n): how often each squared distance occurs between the surfaces of {value >= nodes[k]} and of ``fixed``.

    Both directions are pooled; nodes ascend. A surface point of a level lies at one distance from the fixed surface,
    whatever its node, so that side is looked up once; the other side takes the gaps of all nodes through the same two
    passes, along columns and along rows. A task holds one column or row of an image for all nodes.
    """
    t = np.array(nodes)
    frame = with_neighbours(with_neighbours(px.select(*key, "y", "x", F.col(value).cast("double").alias("_v"), F.col(fixed).alias("_m")), key, "_m").withColumnRenamed("low", "_f"), key, "_v")
    cells = frame.select(*key, "y", "x", "_v", F.col("low").cast("double").alias("_low"), ((F.col("_m") == 1) & (F.col("_f") == 0)).alias("_s"))
    fields = [cells.schema[k] for k in key]
    beside = T.StructType([*fields, *(T.StructField(n, k) for n, k in (("y", T.IntegerType()), ("x", T.IntegerType()), ("_v", T.DoubleType()), ("_low", T.DoubleType()), ("_s", T.BooleanType()), ("_gap", T.IntegerType()), ("_gaps", T.BinaryType())))])
    counts = T.StructType([*fields, T.StructField("k", T.IntegerType()), T.StructField("d2", T.LongType()), T.StructField("n", T.LongType())])

    def gap(ys: np.ndarray, on: np.ndarray) -> np.ndarray:
        last = np.maximum.accumulate(np.where(on, ys, -FAR), axis=-1)
        after = np.minimum.accumulate(np.where(on, ys, 2 * FAR)[..., ::-1], axis=-1)[..., ::-1]
        return np.minimum(np.minimum(ys - last, after - ys), FAR).astype(np.int32)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, there, own, _ in alike(batch, "y"):
                # a row that these columns lack still sees their points
                h, n = batch.column("_h")[int(part[0])].as_py(), len(part)
                ys, (v, low, s) = np.arange(h), (np.zeros((n, h), x.dtype) for x in own)
                v[:, there], low[:, there], s[:, there] = own
                levels = gap(ys, (low[:, None] < t[:, None]) & (t[:, None] <= v[:, None])).transpose(0, 2, 1)
                raw = np.arange(n * h + 1, dtype=np.int32) * (4 * len(t)), np.ascontiguousarray(levels)
                gaps = pa.Array.from_buffers(pa.binary(), n * h, [None, *map(pa.py_buffer, raw)])
                of = pa.array(np.repeat(part, h))
                columns = [*(batch.column(k).take(of) for k in key), pa.array(np.tile(ys, n), pa.int32()), batch.column("x").take(of).cast(pa.int32()), *(pa.array(x.ravel()) for x in (v, low, s, gap(ys, s))), gaps]
                yield pa.record_batch(columns, names=beside.names)

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, xs, (v, low, s, own), gaps in alike(batch, "x"):
                n, w = v.shape
                gaps = np.frombuffer(b"".join(gaps.to_pylist()), "<i4").reshape(n, w, len(t)).astype(np.int64) ** 2
                own = own.astype(np.int64) ** 2
                row, x, k = np.nonzero((low[..., None] < t) & (t <= v[..., None]))
                line, point = np.nonzero(s)
                if w <= NARROW:  # every place with every other, for all rows at once
                    apart = (xs[:, None].astype(np.int64) - xs) ** 2
                    near = (own[:, None] + apart).min(-1)
                    step = max(1, CELLS // (w * len(t)))
                    back = [(gaps[line[i : i + step]] + apart[point[i : i + step], :, None]).min(1) for i in range(0, len(line), step)]
                else:
                    near = np.array([least_squares(xs, own[i, :, None], xs)[:, 0] for i in range(n)]) if len(row) else own
                    back = [least_squares(xs, gaps[i], xs[np.flatnonzero(s[i])]) for i in range(n)]
                back = np.concatenate([np.zeros((0, len(t)), np.int64), *back])
                d2, k, row = np.concatenate([near[row, x], back.ravel()]), np.concatenate([k, np.tile(np.arange(len(t)), len(back))]), np.concatenate([row, np.repeat(line, len(t))])
                both, times = np.unique(((row * len(t) + k) << REACH | d2)[d2 < 1 << REACH], return_counts=True)
                (row, k), d2 = np.divmod(both >> REACH, len(t)), both & ((1 << REACH) - 1)
                of = pa.array(part[row])
                yield pa.record_batch([*(batch.column(c).take(of) for c in key), pa.array(k, pa.int32()), pa.array(d2, pa.int64()), pa.array(times, pa.int64())], names=counts.names)

    columns = shipped(cells).groupBy(*key, "x").agg(F.sort_array(F.collect_list(F.struct("y", "_v", "_low", "_s"))).alias("_c"))
    columns = columns.join(cells.groupBy(*key).agg((F.max("y") + 1).alias("_h")), key)
    rows = columns.mapInArrow(down, beside).groupBy(*key, "y").agg(F.sort_array(F.collect_list(F.struct("x", "_v", "_low", "_s", "_gap", "_gaps"))).alias("_c"))
    return rows.mapInArrow(across, counts).groupBy(*key, "k", "d2").agg(F.sum("n").alias("n"))


def lowest_beside(image: np.ndarray, y: np.ndarray, x: np.ndarray, value: np.ndarray) -> np.ndarray:
    """``with_neighbours`` of pixels in order of image, y and x: the smallest of the four neighbours, 0 outside the frame."""
    low = np.full(len(value), np.inf)
    for line, order in ((y, None), (x, np.lexsort((y, x, image)))):
        i, at, v = (image, line, value) if order is None else (image[order], line[order], value[order])
        beside = (i[1:] == i[:-1]) & (at[1:] == at[:-1])
        near = np.minimum(np.append(0, np.where(beside, v[:-1], 0)), np.append(np.where(beside, v[1:], 0), 0))
        if order is not None:
            near, back = np.empty_like(near), near
            near[order] = back
        low = np.minimum(low, near)
    return low


def steps_along(on: np.ndarray) -> np.ndarray:
    """For each cell of arrays (..., y, x) the steps along its column to the nearest that is ``on``, ``FAR_WHOLE`` if none is."""
    ys = np.arange(on.shape[-2], dtype=np.int32)[:, None]
    last = np.maximum.accumulate(np.where(on, ys, np.int32(-FAR_WHOLE)), axis=-2)
    after = np.minimum.accumulate(np.where(on, ys, np.int32(2 * FAR_WHOLE))[..., ::-1, :], axis=-2)[..., ::-1, :]
    return np.minimum(np.minimum(ys - last, after - ys), FAR_WHOLE)


def extremes(h: int, w: int, nodes: np.ndarray, image: np.ndarray, y: np.ndarray, x: np.ndarray, v: np.ndarray, low: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(images, nodes) of the largest and the 95th percentile of pooled distances, of images of one frame; NaN where none is.

    The same separable transform as ``pooled_distances``, for a few whole images at once.
    """
    n, m = int(image[-1]) + 1, len(nodes)
    fixed, level, below = np.zeros((n, h, w), bool), np.zeros((n, h, w)), np.zeros((n, h, w))
    fixed[image, y, x], level[image, y, x], below[image, y, x] = s, v, low
    xs = np.arange(w, dtype=np.int32)
    # a level's points lie at one distance from the fixed surface, for all nodes between low and v
    i, a, b = np.nonzero(below < level)
    first, last = np.searchsorted(nodes, below[i, a, b], "right"), np.searchsorted(nodes, level[i, a, b], "right")
    i, a, b, first, times = (z[last > first] for z in (i, a, b, first, last - first))
    own = steps_along(fixed)
    near = (own[i, a].astype(np.int64) ** 2 + (b[:, None] - xs) ** 2).min(-1, initial=FAR_WHOLE**2)
    k = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)
    found = [(np.repeat(i, times) * m + k) << REACH | np.repeat(near, times)]
    # the fixed surface's points look at each node's level
    i, a, b = np.nonzero(fixed)
    if len(i):
        gaps = np.ascontiguousarray(steps_along((below[:, None] < nodes[:, None, None]) & (nodes[:, None, None] <= level[:, None])).transpose(0, 2, 1, 3))
        gaps *= gaps
        step = max(1, CELLS // (m * w))
        for at in range(0, len(i), step):
            part = slice(at, at + step)
            d2 = (gaps[i[part], a[part]] + ((b[part, None] - xs) ** 2).astype(np.int32)[:, None]).min(-1)
            found.append(((i[part, None] * m + np.arange(m)) << REACH | d2).ravel())
    pooled = np.concatenate(found)
    pooled = np.sort(pooled[(pooled & ((1 << REACH) - 1)) < FAR_WHOLE**2])
    far, most = np.full(n * m, np.nan), np.full(n * m, np.nan)
    if len(pooled):
        of, d = pooled >> REACH, np.sqrt((pooled & ((1 << REACH) - 1)).astype(float))
        start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        size = np.diff(np.append(start, len(of)))
        place = 0.95 * (size - 1)
        lo, hi = np.floor(place).astype(int), np.ceil(place).astype(int)
        far[of[start]] = d[start + size - 1]
        most[of[start]] = np.where(lo == hi, d[start + lo], (hi - place) * d[start + lo] + (place - lo) * d[start + hi])
    return far.reshape(n, m), most.reshape(n, m)


def farthest(px: DataFrame, key: list[str], value: str, fixed: str, nodes: list[float], whole: int = WHOLE) -> DataFrame:
    """(key, far, far95): arrays over nodes of the largest and the 95th percentile of the distances that ``pooled_distances``
    counts, null where a surface is empty. ``px`` is a written table.

    Images that a task can hold are taken whole, so that no row arises for a pixel and a node; larger ones go by their
    columns and rows.
    """
    t = np.array(nodes)
    both = px.select(*key, "y", "x", F.col(value).cast("double").alias("_v"), F.col(fixed).cast("double").alias("_m"))
    small, large = by_size(both, key, whole)
    lists = T.ArrayType(T.DoubleType())
    schema = T.StructType([*(both.schema[k] for k in key), T.StructField("far", lists), T.StructField("far95", lists)])

    def work(piece: pa.Table, first: np.ndarray) -> pa.Table:
        y, x = (piece.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
        v, m = (piece.column(c).fill_null(0.0).to_numpy() for c in ("_v", "_m"))
        counts = np.diff([*first, len(y)])
        image = np.repeat(np.arange(len(first)), counts)
        low = lowest_beside(image, y, x, np.where(np.isnan(v), np.inf, v))
        v = np.where(np.isnan(v), -np.inf, v)  # reaches no node
        s = (m == 1) & (lowest_beside(image, y, x, m) == 0)
        h, w = (np.maximum.reduceat(z, first) + 1 for z in (y, x))
        out = np.full((2, len(first), len(t)), np.nan)
        for frame in np.unique(h << 32 | w):
            high, wide = int(frame >> 32), int(frame & ((1 << 32) - 1))
            same = np.flatnonzero((h == high) & (w == wide))
            step = max(1, CELLS // (len(t) * high * wide))
            for at in range(0, len(same), step):
                part = same[at : at + step]
                rows = np.concatenate([np.arange(first[i], first[i] + counts[i]) for i in part])
                out[:, part] = extremes(high, wide, t, np.repeat(np.arange(len(part)), counts[part]), *(z[rows] for z in (y, x, v, low, s)))
        places = pa.array(np.arange(len(first) + 1, dtype=np.int32) * len(t))
        arrays = [pa.ListArray.from_arrays(places, pa.array(z.ravel(), mask=np.isnan(z.ravel()))) for z in out]
        return pa.table([*(piece.column(k).take(pa.array(first)) for k in key), *arrays], names=schema.names)

    found = per_image(small, key, shares(px), work, schema)
    if large is None:
        return found
    d = pooled_distances(large, key, "_v", "_m", nodes).groupBy(*key, "k").agg(F.sqrt(F.max("d2").cast("double")).alias("m"), F.percentile(F.sqrt(F.col("d2").cast("double")), F.lit(0.95), F.col("n")).alias("q"))
    d = d.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("m", "q")))).alias("d"))
    at = F.sequence(F.lit(0), F.lit(len(t) - 1))
    return found.unionByName(d.select(*key, F.transform(at, lambda k: F.try_element_at("d", k)["m"]).alias("far"), F.transform(at, lambda k: F.try_element_at("d", k)["q"]).alias("far95")))


def image_sizes(px: DataFrame, key: list[str], left, right) -> DataFrame:
    """diagonal, left_size and right_size of two columns for each image: numbers of pixels; rows of one place count each."""
    h, w = F.max("y") + 1, F.max("x") + 1
    return px.groupBy(*key).agg(F.sqrt((h * h + w * w).cast("double")).alias("diagonal"), left.alias("left_size"), right.alias("right_size"))


def over_diagonal(distance: Column, left: Column, right: Column) -> Column:
    """A distance over the diagonal, at most 1; both masks empty give 0, one empty gives 1."""
    return F.when((left == 0) & (right == 0), F.lit(0.0)).when((left == 0) | (right == 0), F.lit(1.0)).otherwise(F.least(F.lit(1.0), distance / F.col("diagonal")))


def mask_distances(px: DataFrame, key: list[str], left: str, right: str, whole: int = WHOLE, kept: bool = False) -> DataFrame:
    """nhd, nhd95 of two 0/1 columns of a pixel table, and hd and hd95 in pixels; ``kept``: ``px`` is a written table.

    Largest and 95th percentile of the distances of both surfaces to each other, over the diagonal, at most 1.
    """
    px = px.select(*key, "y", "x", left, right)
    px = px if kept else written(px, "masks")
    d = image_sizes(px, key, F.sum(left), F.sum(right)).join(farthest(px, key, left, right, [0.5], whole), key, "left")
    d = d.select(*key, "diagonal", *(over_diagonal(F.get(c, F.lit(0)), F.col("left_size"), F.col("right_size")).alias(n) for c, n in (("far", "nhd"), ("far95", "nhd95"))))
    return d.select(*key, "nhd", "nhd95", (F.col("nhd") * F.col("diagonal")).alias("hd"), (F.col("nhd95") * F.col("diagonal")).alias("hd95"))


def distance_ladder(px: DataFrame, key: list[str], ms: list[int], gamma: float = 0.5, whole: int = WHOLE) -> DataFrame:
    """confidence_nhd_m{m} and confidence_nhd95_m{m}: minus the mean distance of each node's level set from the action, all rules at once."""
    midpoints = {m: [(k + 0.5) / m for k in range(m)] for m in ms}
    union = sorted({t for ts in midpoints.values() for t in ts})
    px = written(px.select(*key, "y", "x", "p", (F.col("p") >= gamma).cast("int").alias("_a")), "levels")
    d = image_sizes(px, key, F.max("p"), F.sum("_a")).join(farthest(px, key, "p", "_a", union, whole), key, "left")
    size = lambda t: (F.col("left_size") >= t).cast("int")
    none = F.array_repeat(F.lit(None).cast("double"), len(union))  # of images without a surface
    each = {c: F.zip_with(F.coalesce(f, none), F.array(*map(F.lit, union)), lambda v, t: over_diagonal(v, size(t), F.col("right_size"))) for c, f in (("nhd", "far"), ("nhd95", "far95"))}
    d = d.select(*key, *(v.alias(c) for c, v in each.items()))
    mean = lambda c, ts: F.aggregate(F.array(*[F.get(c, F.lit(union.index(t))) for t in ts]), F.lit(0.0), lambda s, v: s + v) / len(ts)
    return d.select(*key, *((-mean(c, ts)).alias(f"confidence_{c}_m{m}") for m, ts in midpoints.items() for c in each))
