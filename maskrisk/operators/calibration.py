"""Calibration of pixel probabilities: Brier score, fixed-bin reliability, and what a ladder of thresholds does to masks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import count_if
from .pixels import nodes


def brier(px: DataFrame, key: list[str], cond: list[str]) -> DataFrame:
    """For each condition the pixel-weighted Brier score and the mean of the images' own."""
    e = (F.col("p") - F.col("truth")) * (F.col("p") - F.col("truth"))
    per = px.groupBy(*key).agg(F.sum(e).alias("s"), F.count("*").alias("n"))
    return per.groupBy(*cond).agg((F.sum("s") / F.sum("n")).alias("pixel_weighted"), F.avg(F.col("s") / F.col("n")).alias("image_mean"), F.sum("n").alias("pixels"))


def bin_of(p, bins: int):
    return F.least(F.floor(p * bins), F.lit(bins - 1)).cast("int")


def reliability_table(px: DataFrame, cond: list[str], bins: int = 15) -> DataFrame:
    """A row for each condition and bin: count, mean probability, foreground rate, gap; nulls where the bin is empty."""
    got = px.groupBy(*cond, bin_of(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("truth").alias("rate"))
    every = px.select(*cond).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(got, [*cond, "bin"], "left").select(*cond, "bin", F.coalesce("n", F.lit(0)).alias("n"), "mean_p", "rate", (F.col("rate") - F.col("mean_p")).alias("gap"))


def expected_calibration_error(px: DataFrame, cond: list[str], bins: int = 15) -> DataFrame:
    """ece: the mean over pixels of their bin's absolute gap."""
    got = px.groupBy(*cond, bin_of(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg("truth") - F.avg("p")).alias("gap"))
    return got.groupBy(*cond).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.sum("n").alias("pixels"))


def ladder_counts(px: DataFrame, key: list[str], m: int = 32) -> DataFrame:
    """n, truth_pixels and c for each image: an array of the pixels that reach each of the m nodes, in one aggregation."""
    return px.groupBy(*key).agg(F.count("*").alias("n"), F.sum("truth").cast("long").alias("truth_pixels"), F.array(*[count_if(F.col("p") >= t) for t in nodes(m)]).alias("c"))


def ladder_masks(px: DataFrame, key: list[str], cond: list[str], m: int = 32) -> DataFrame:
    """For each condition and node: foreground fraction, pixel-weighted and as image mean, and the share of empty masks."""
    each = ladder_counts(px, key, m).select(*cond, "n", F.posexplode("c").alias("k", "c"))
    return each.groupBy(*cond, "k").agg((F.sum("c") / F.sum("n")).alias("pixel_fraction"), F.avg(F.col("c") / F.col("n")).alias("image_fraction"), F.avg((F.col("c") == 0).cast("double")).alias("empty_ratio"))


def node_changes(px: DataFrame, key: list[str], m: int = 32) -> DataFrame:
    """``ladder_counts`` with d: the pixels that change between neighbouring nodes."""
    return ladder_counts(px, key, m).withColumn("d", F.transform(F.sequence(F.lit(0), F.lit(m - 2)), lambda k: F.get("c", k) - F.get("c", k + 1)))


def adjacent_changes(px: DataFrame, key: list[str], cond: list[str], m: int = 32) -> DataFrame:
    """For each condition and pair of neighbouring nodes: changed pixels, mean and largest fraction, share of no change."""
    each = node_changes(px, key, m).select(*cond, "n", F.posexplode("d").alias("k", "d"))
    return each.groupBy(*cond, "k").agg(F.sum("d").alias("changed"), F.avg(F.col("d") / F.col("n")).alias("mean_fraction"), F.max(F.col("d") / F.col("n")).alias("max_fraction"), F.avg((F.col("d") == 0).cast("double")).alias("zero_ratio"))


def distinct_masks(px: DataFrame, key: list[str], cond: list[str], m: int = 32) -> DataFrame:
    """Histogram of how many different masks the ladder gives for an image: one more than its changes."""
    each = node_changes(px, key, m).select(*cond, (F.size(F.filter("d", lambda d: d > 0)) + 1).alias("masks"))
    return each.groupBy(*cond, "masks").agg(F.count("*").alias("images"))


def mask_summary(px: DataFrame, key: list[str], cond: list[str]) -> DataFrame:
    """For each condition: pixels, foreground fraction of the truth weighted by pixels and as image mean, empty masks."""
    per = px.groupBy(*key).agg(F.count("*").alias("n"), F.sum("truth").alias("t"))
    return per.groupBy(*cond).agg(F.sum("n").alias("pixels"), (F.sum("t") / F.sum("n")).alias("pixel_fraction"), F.avg(F.col("t") / F.col("n")).alias("image_fraction"), count_if(F.col("t") == 0).alias("empty"), F.avg((F.col("t") == 0).cast("double")).alias("empty_ratio"))


def descriptors(px: DataFrame, key: list[str], m: int = 32) -> DataFrame:
    """A nested record for each image: what depends on the prediction, on the label, and on both."""
    base = node_changes(px, key, m)
    hard = px.groupBy(*key).agg(count_if((F.col("p") >= 0.5) != (F.col("truth") == 1)).alias("wrong"), F.avg((F.col("p") - F.col("truth")) * (F.col("p") - F.col("truth"))).alias("brier"))
    return base.join(hard, key).select(*key, F.struct("n", F.col("c").alias("ladder"), F.col("d").alias("changes")).alias("prediction_only"), F.struct("truth_pixels").alias("label_only"), F.struct("wrong", "brier").alias("label_outcomes"))


def headline(px: DataFrame, key: list[str], cond: list[str], bins: int = 15, m: int = 32) -> DataFrame:
    """Seven numbers for each condition."""
    wrong = px.groupBy(*cond).agg(F.avg(((F.col("p") >= 0.5) != (F.col("truth") == 1)).cast("double")).alias("hard_error"), F.avg("truth").alias("foreground"))
    changes = node_changes(px, key, m).groupBy(*cond).agg(F.avg(F.size(F.filter("d", lambda d: d > 0)) + 1).alias("mean_masks"), F.avg((F.get("c", F.lit(m - 1)) == 0).cast("double")).alias("top_empty"))
    b = brier(px, key, cond).select(*cond, F.col("pixel_weighted").alias("brier"), F.col("image_mean").alias("brier_image"))
    e = expected_calibration_error(px, cond, bins).select(*cond, "ece")
    return b.join(e, cond).join(wrong, cond).join(changes, cond)


def accumulators(rows: DataFrame, group: list, bins: int = 15) -> DataFrame:
    """Sums by bin that add up over parts of the data: n, sums of p, truth and squared error."""
    e = (F.col("p") - F.col("truth")) * (F.col("p") - F.col("truth"))
    return rows.groupBy(*group, bin_of(F.col("p"), bins).alias("bin")).agg(F.count("*").alias("n"), F.sum("p").alias("sum_p"), F.sum("truth").cast("long").alias("sum_truth"), F.sum(e).alias("sum_sq"))


def merged(parts: DataFrame, group: list[str]) -> DataFrame:
    """Accumulators of parts, added up."""
    return parts.groupBy(*group, "bin").agg(*[F.sum(c).alias(c) for c in ("n", "sum_p", "sum_truth", "sum_sq")])


def from_accumulators(acc: DataFrame, group: list[str]) -> DataFrame:
    """Brier score and calibration error of each group."""
    gap = F.abs(F.col("sum_truth") - F.col("sum_p"))
    return acc.groupBy(*group).agg(F.sum("n").alias("n"), (F.sum("sum_sq") / F.sum("n")).alias("brier"), (F.sum(gap) / F.sum("n")).alias("ece"))


