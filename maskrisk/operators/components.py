"""4-connected components, balanced grids, and Dice confidence under per-block thresholds."""

from __future__ import annotations

import hashlib
import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scores import dice_loss, hash_unit
from ..functions.shared import shipped, written
from .images import WHOLE, by_size, changes, per_image, shares

#: Rows of a band: a task joins the runs of one band of one image.
BAND_ROWS = 128
log = logging.getLogger(__name__)


def band_roots(y: list[int], x0: list[int], x1: list[int], v: list) -> list[int]:
    """For each run of a band, in reading order, the place of the first run of its component within the band.

    One pass joins each run with those of the row above that it touches and that have its value, a second looks up.
    """
    root = list(range(len(y)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    above = low = 0  # where the row above begins, and its first run that can still touch
    start = 0
    for i in range(len(y)):
        if i and y[i] != y[i - 1]:
            above, start = (start, i) if y[i] == y[i - 1] + 1 else (i, i)
            low = above
        while low < start and x1[low] < x0[i]:
            low += 1
        j = low
        while j < start and x0[j] <= x1[i]:
            if v[j] == v[i]:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
            j += 1
    return [find(i) for i in range(len(y))]


def contracted(edges: DataFrame, key: list[str]) -> DataFrame:
    """(key, node, root): the smallest node of the component of each node of an edge table (key, u, v).

    Alternating large and small stars; each round is a written table, so that no plan and no size estimate grows. Rounds
    grow with the logarithm of the longest chain of edges; the loop ends when a round changes nothing.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*key, "u", "v").cast("decimal(38,0)"))).first())

    at = [F.col(k) for k in key]
    now = written(edges.select(*at, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    before, rounds = state(now), 0
    while before[0]:
        both = now.unionByName(now.select(*at, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*key, "u").agg(F.min("v").alias("m"))
        large = both.join(low, [*key, "u"]).where("v > u").select(*at, F.col("v").alias("u"), F.least("u", "m").alias("v")).where("u > v").distinct()
        low = large.groupBy(*key, "u").agg(F.min("v").alias("m"))
        star = F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v"))))
        now = written(large.join(low, [*key, "u"]).select(*at, star.alias("e")).select(*at, "e.u", "e.v").where("u > v").distinct(), "edges")
        rounds, after = rounds + 1, state(now)
        if after == before:
            break
        before = after
    log.info("components of band borders settled in %d rounds", rounds)
    return now.select(*at, F.col("u").alias("node"), F.col("v").alias("root"))


def components(px: DataFrame, key: list[str], value: str, band_rows: int = BAND_ROWS, whole: int = WHOLE) -> DataFrame:
    """``px`` with label: 4-connected components of equal ``value``, contiguous from 0 in reading order of their first pixel.

    Rows are collapsed to runs, and runs that touch are joined: for images that a task can hold within the image, for
    larger ones within each band of rows and then over the borders of bands.
    """
    px = written(px, "pixels")
    small, large = by_size(px, key, whole)
    schema = T.StructType([*px.schema.fields, T.StructField("label", T.IntegerType())])

    def label(piece: pa.Table, first: np.ndarray) -> pa.Table:
        y, x = (piece.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
        image = np.repeat(np.arange(len(first)), np.diff([*first, len(y)]))
        start = changes(piece.column("y")) | changes(piece.column(value))
        start[first] = True
        at = np.flatnonzero(start)
        end = np.append(at[1:], len(y)) - 1
        # images lie far apart in y, so no run touches one of another image
        root = np.array(band_roots((y + (image << 33))[at].tolist(), x[at].tolist(), x[end].tolist(), piece.column(value).take(pa.array(at)).to_pylist()))
        number = np.cumsum(root == np.arange(len(at))) - 1  # of a component, at its first run
        run = np.cumsum(start) - 1
        labels = number[root][run] - number[root][run[first]][image]
        return piece.append_column("label", pa.array(labels, pa.int32()))

    found = per_image(small, key, shares(px), label, schema)
    return found if large is None else found.unionByName(banded(large, key, value, band_rows).select(schema.names))


def banded(px: DataFrame, key: list[str], value: str, band_rows: int) -> DataFrame:
    """``components`` of images of any size.

    The runs of each band of rows are joined in one task; runs that touch across the border of two bands are edges
    between the components of the bands, and these are contracted.
    """
    w = W.partitionBy(*key, "y").orderBy("x")
    run = F.sum(F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)).over(w)
    numbered = px.select("*", run.alias("_run"))
    runs = numbered.groupBy(*key, "y", "_run").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.first(value).alias("v"))
    runs = runs.withColumn("node", F.col("y").cast("long") * (1 << 32) + F.col("x0")).withColumn("band", F.floor(F.col("y") / band_rows))
    schema = T.StructType([*runs.schema.fields, T.StructField("root", T.LongType())])

    def join(band: pa.Table) -> pa.Table:
        band = band.take(pa.array(np.argsort(band.column("node").to_numpy())))
        root = band_roots(*(band.column(c).to_pylist() for c in ("y", "x0", "x1", "v")))
        return band.append_column("root", band.column("node").take(pa.array(root, pa.int64())).cast(pa.int64())).select(schema.names)

    runs = written(shipped(runs).groupBy(*key, "band").applyInArrow(join, schema), "runs")
    a, b = runs.where((F.col("y") + 1) % band_rows == 0).alias("a"), runs.where(F.col("y") % band_rows == 0).alias("b")
    touch = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key] + [F.col("b.y") == F.col("a.y") + 1, F.col("a.v") == F.col("b.v"), F.col("a.x0") <= F.col("b.x1"), F.col("b.x0") <= F.col("a.x1")]
    edges = a.join(b, touch).select(*[F.col(f"a.{k}").alias(k) for k in key], F.col("a.root").alias("u"), F.col("b.root").alias("v"))
    upper = contracted(edges, key).select(*key, F.col("node").alias("root"), F.col("root").alias("_top"))
    tops = runs.join(upper, [*key, "root"], "left").select(*key, "y", "_run", F.coalesce("_top", "root").alias("_top"))
    named = tops.select(*key, "_top").distinct().withColumn("label", F.row_number().over(W.partitionBy(*key).orderBy("_top")) - 1)
    at = tops.join(named, [*key, "_top"]).select(*key, "y", "_run", "label")
    return numbered.join(at, [*key, "y", "_run"]).drop("_run")


def grid(px: DataFrame, key: list[str], blocks: DataFrame, parts: int | None = None) -> DataFrame:
    """``px`` with label: a balanced grid of exactly ``blocks.target`` cells for each image, by arithmetic on columns alone.

    ``parts``: tasks that the pixels are dealt to. Rows of cells are near the square shape; the first rows take one cell
    more; edges are evenly spaced whole numbers.
    """
    size = px.groupBy(*key).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w")).join(blocks.select(*key, F.col("target").cast("int").alias("target")), key)
    wish = F.greatest(F.lit(1), F.bround(F.sqrt(F.col("target") * F.col("h") / F.col("w")), 0).cast("int"))
    first = F.least(F.col("h"), wish, F.col("target"))
    fit = F.filter(F.sequence(first, F.least(F.col("h"), F.col("target"))), lambda r: F.ceil(F.col("target") / r) <= F.col("w"))
    size = size.withColumn("rows", F.get(fit, F.lit(0)))
    j = px.join(size, key) if parts is None else px.repartition(parts, *key).join(size.repartition(parts, *key), key)
    # edges floor(i * h / rows): the last i whose edge is at most y
    row = F.floor((F.col("rows") * (F.col("y") + 1) - 1) / F.col("h")).cast("int")
    base, more = F.floor(F.col("target") / F.col("rows")).cast("int"), F.col("target") % F.col("rows")
    j = j.withColumn("_row", row).withColumn("_cols", base + F.when(F.col("_row") < more, 1).otherwise(0))
    col = F.floor((F.col("_cols") * (F.col("x") + 1) - 1) / F.col("w")).cast("int")
    before = F.col("_row") * base + F.least(F.col("_row"), more)
    return j.withColumn("label", (before + col).cast("int")).drop("h", "w", "target", "rows", "_row", "_cols")


def partition(px: DataFrame, key: list[str], coupling: str, gamma: float = 0.5, threshold: float | None = None) -> DataFrame:
    """``px`` with label: components of the action or of p >= threshold, or a grid with as many blocks."""
    if coupling not in ("action_components", "action_grid", "proposal_components", "proposal_grid"):
        raise ValueError(f"unknown coupling {coupling}")
    if coupling.startswith("proposal") != (threshold is not None):
        raise ValueError("a threshold goes with proposals, and only with them")
    cut = gamma if threshold is None else threshold
    found = components(px.withColumn("_m", (F.col("p") >= cut).cast("int")), key, "_m").drop("_m")
    if coupling.endswith("components"):
        return found
    found = written(found, "found")
    return grid(found.drop("label"), key, found.groupBy(*key).agg((F.max("label") + 1).alias("target")), shares(found))


def partition_diagnostics(labelled: DataFrame, key: list[str]) -> DataFrame:
    """Number of blocks and the share of the largest for each image."""
    b = labelled.groupBy(*key, "label").agg(F.count("*").alias("c"))
    return b.groupBy(*key).agg(F.count("*").alias("num_blocks"), (F.max("c") / F.sum("c")).alias("largest_block_fraction"))


def thresholds(seed: int, sample: str | None, coupling: str, repeats: int, draws: int, label: int) -> np.ndarray:
    """``hash_unit`` of a block's draws, as (repeat, draw)."""
    head, tail = "|".join(x for x in (str(seed), sample, coupling) if x is not None), f"|{label}"
    raw = b"".join(hashlib.sha256(f"{head}|{r}|{d}{tail}".encode()).digest()[:8] for r in range(repeats) for d in range(draws))
    return (((np.frombuffer(raw, ">u8") >> 12) + 0.5) / 2.0**52).reshape(repeats, draws)


def partition_dice(labelled: DataFrame, key: list[str], coupling: str, draws: int, repeats: int, seed: int, gamma: float = 0.5, whole: int = WHOLE) -> DataFrame:
    """(key, repeat, confidence): minus the mean Dice loss over antithetic draws of one threshold for each block.

    Thresholds are hashes of seed, sample, coupling, repeat, draw and block; the second half of the draws mirrors the first.
    A block's probabilities are put in descending order, where running sums have at each threshold what reaches it. Of
    images that a task can hold no threshold leaves the task; the others' are rows.
    """
    px = written(labelled.select(*key, "y", "x", "p", "label", F.col("sample_id").cast("string").alias("_name")), "labelled")
    small, large = by_size(px, key, whole)
    schema = T.StructType([*(px.schema[k] for k in key), T.StructField("repeat", T.IntegerType()), T.StructField("confidence", T.DoubleType())])

    def work(piece: pa.Table, first: np.ndarray) -> pa.Table:
        p = piece.column("p").cast(pa.float64()).fill_null(-np.inf).to_numpy()
        p, label = np.where(np.isnan(p), np.inf, p), piece.column("label").to_numpy()
        image = np.repeat(np.arange(len(first)), np.diff([*first, len(p)]))
        order = np.lexsort((-p, label, image))
        down, label, of = -p[order], label[order], image[order]
        inside = np.append(0, np.cumsum(-down >= gamma))
        starts = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (of[1:] != of[:-1])))
        z, w = np.zeros((2, len(first), 2, repeats, draws // 2), np.int64)
        names = piece.column("_name").take(pa.array(first)).to_pylist()
        for at, to in zip(starts.tolist(), [*starts[1:].tolist(), len(p)], strict=True):
            u = thresholds(seed, names[of[at]], coupling, repeats, draws // 2, int(label[at]))
            reach = at + np.searchsorted(down[at:to], -np.stack([u, 1 - u]), "right")
            over = inside[reach] - inside[at]
            z[of[at]] += over
            w[of[at]] += reach - at - over
        action = np.diff(inside[[*first, len(p)]])[:, None, None, None]
        sizes = z + w + action
        loss = np.where(sizes == 0, 0.0, 1 - 2 * z / np.maximum(sizes, 1))
        keys = pa.array(np.repeat(first, repeats))
        return pa.table([*(piece.column(k).take(keys) for k in key), pa.array(np.tile(np.arange(repeats), len(first)), pa.int32()), pa.array(-loss.mean((1, 3)).ravel())], names=schema.names)

    found = per_image(small, key, shares(px), work, schema)
    return found if large is None else found.unionByName(spread_dice(large, key, coupling, draws, repeats, seed, gamma))


def spread_dice(labelled: DataFrame, key: list[str], coupling: str, draws: int, repeats: int, seed: int, gamma: float) -> DataFrame:
    """``partition_dice`` of images of any size: rows grow with the numbers of thresholds and of distinct probabilities,
    not with their product."""
    a = F.col("p") >= gamma
    cells = labelled.groupBy(*key, "label", F.col("p").alias("v")).agg(F.sum(F.when(a, 1).otherwise(0)).alias("i"), F.sum(F.when(a, 0).otherwise(1)).alias("o"))
    sizes = cells.groupBy(*key).agg(F.sum("i").alias("action"))
    d = cells.select(*key, "label").distinct().withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws // 2 - 1))))
    u = hash_unit(F.lit(seed), F.col("sample_id"), F.lit(coupling), F.col("repeat"), F.col("draw"), F.col("label"))
    d = d.withColumn("u", u).withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("v", F.when(F.col("half") == 0, F.col("u")).otherwise(1 - F.col("u"))).drop("u")
    order = W.partitionBy(*key, "label").orderBy(F.desc("v"), F.asc_nulls_first("draw")).rowsBetween(W.unboundedPreceding, 0)
    both = cells.unionByName(d, allowMissingColumns=True)
    s = both.withColumns({"z": F.sum("i").over(order), "w": F.sum("o").over(order)}).where("draw is not null")
    s = s.groupBy(*key, "repeat", "draw", "half").agg(F.sum(F.coalesce("z", F.lit(0))).alias("z"), F.sum(F.coalesce("w", F.lit(0))).alias("w")).join(sizes, key)
    return s.groupBy(*key, "repeat").agg((-F.avg(dice_loss(F.col("z"), F.col("z") + F.col("w"), F.col("action")))).alias("confidence"))


def repeat_summary(estimates: DataFrame, key: list[str]) -> DataFrame:
    """Mean and population deviation over repeats for each image, and the repeats as an array in order."""
    return estimates.groupBy(*key).agg(F.avg("confidence").alias("mean"), F.stddev_pop("confidence").alias("sd"), F.transform(F.array_sort(F.collect_list(F.struct("repeat", "confidence"))), lambda x: x["confidence"]).alias("repeats"))
