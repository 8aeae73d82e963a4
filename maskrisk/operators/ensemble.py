"""Ensembles: a mean map over aligned members, and how far members agree with it and with each other."""

from __future__ import annotations

from math import exp

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import count_if, dice_loss, entropy_nats
from ..functions.shared import written


def mean_map(ens: DataFrame, key: list[str], members: int) -> DataFrame:
    """One map of mean probabilities; a pixel without all members, or whose members disagree on the truth, is an error."""
    m = ens.groupBy(*key, "y", "x").agg(F.avg(F.col("p").cast("double")).alias("p"), F.count("*").alias("n"), F.min("truth").alias("truth"), F.max("truth").alias("other"))
    wrong = (F.col("n") != members) | (F.col("truth") != F.col("other"))
    p = F.when(wrong, F.raise_error(F.lit("members of an image differ in shape or truth")).cast("double")).otherwise(F.col("p"))
    return m.select(*key, "y", "x", p.cast("float").cast("double").alias("p"), "truth")


def threshold_iou_stability(px: DataFrame, key: list[str], offset: float = 1.0) -> DataFrame:
    """stability: pixels above the upper logit cut over those above the lower one; 1 where none is above the lower."""
    low = 1 / (1 + exp(offset))
    s = px.groupBy(*key).agg(count_if(F.col("p") >= low).alias("a"), count_if(F.col("p") >= 1 - low).alias("b"))
    return s.select(*key, F.when(F.col("a") == 0, F.lit(1.0)).otherwise(F.col("b") / F.col("a")).alias("stability"))


def member_masks(ens: DataFrame, key: list[str], members: int, gamma: float = 0.5) -> DataFrame:
    """(key, member, y, x, m, a): each member's mask and the action of ``mean_map``, over one deal of the pixels."""
    w = W.partitionBy(*key, "y", "x")
    e = ens.withColumns({"_mean": F.avg(F.col("p").cast("double")).over(w), "_n": F.count("*").over(w), "_low": F.min("truth").over(w), "_high": F.max("truth").over(w)})
    wrong = (F.col("_n") != members) | (F.col("_low") != F.col("_high"))
    mean = F.when(wrong, F.raise_error(F.lit("members of an image differ in shape or truth")).cast("double")).otherwise(F.col("_mean"))
    return e.select(*key, "member", "y", "x", (F.col("p") >= gamma).cast("int").alias("m"), (mean.cast("float").cast("double") >= gamma).cast("int").alias("a"))


def member_scores(ens: DataFrame, key: list[str], members: int, gamma: float = 0.5) -> DataFrame:
    """``member_dice`` and ``member_distances`` against ``mean_map`` in one table; masks are worked out and written once."""
    from .geometry import mask_distances

    j = written(member_masks(ens, key, members, gamma), "members")
    s = j.groupBy(*key, "member").agg(F.sum(F.col("m") * F.col("a")).alias("_z"), F.sum("m").alias("_s"), F.sum("a").alias("_a"))
    each = s.select(*key, "member", dice_loss(F.col("_z"), F.col("_s"), F.col("_a")).alias("_d")).join(mask_distances(j, [*key, "member"], "m", "a", kept=True), [*key, "member"])
    return each.groupBy(*key).agg((-F.avg("_d")).alias("confidence_q_dice"), (-F.avg("nhd")).alias("confidence_q_nhd"), (-F.avg("nhd95")).alias("confidence_q_nhd95"))


def member_dice(ens: DataFrame, mean: DataFrame, key: list[str], gamma: float = 0.5) -> DataFrame:
    """confidence_q_dice: minus the mean Dice loss of the members' masks against the mean map's action."""
    j = ens.select(*key, "member", "y", "x", (F.col("p") >= gamma).alias("m")).join(mean.select(*key, "y", "x", (F.col("p") >= gamma).alias("a")), [*key, "y", "x"])
    s = j.groupBy(*key, "member").agg(count_if(F.col("m") & F.col("a")).alias("z"), count_if(F.col("m")).alias("s"), count_if(F.col("a")).alias("a"))
    return s.groupBy(*key).agg((-F.avg(dice_loss(F.col("z"), F.col("s"), F.col("a")))).alias("confidence_q_dice"))


def member_distances(ens: DataFrame, mean: DataFrame, key: list[str], gamma: float = 0.5) -> DataFrame:
    """confidence_q_nhd and confidence_q_nhd95: the same with surface distances."""
    from .geometry import mask_distances

    j = ens.select(*key, "member", "y", "x", (F.col("p") >= gamma).cast("int").alias("m")).join(mean.select(*key, "y", "x", (F.col("p") >= gamma).cast("int").alias("a")), [*key, "y", "x"])
    d = mask_distances(j, [*key, "member"], "m", "a")
    return d.groupBy(*key).agg((-F.avg("nhd")).alias("confidence_q_nhd"), (-F.avg("nhd95")).alias("confidence_q_nhd95"))


def all_member_iou(ens: DataFrame, key: list[str], gamma: float = 0.5) -> DataFrame:
    """iou of all members' masks; 1 where all are empty."""
    m = ens.groupBy(*key, "y", "x").agg(F.min((F.col("p") >= gamma).cast("int")).alias("low"), F.max((F.col("p") >= gamma).cast("int")).alias("high"))
    s = m.groupBy(*key).agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    return s.select(*key, F.when(F.col("high") == 0, F.lit(1.0)).otherwise(F.col("low") / F.col("high")).alias("iou"))


def pairwise_dice(ens: DataFrame, key: list[str], gamma: float = 0.5) -> DataFrame:
    """similarity: the mean Dice similarity over pairs of members; a fixed few members are compared within each pixel."""
    per = ens.groupBy(*key, "y", "x").agg(F.sort_array(F.collect_list(F.struct("member", (F.col("p") >= gamma).cast("int").alias("m")))).alias("ms"))
    pairs = per.select(*key, F.posexplode("ms").alias("i", "left"), "ms").select(*key, "i", "left", F.posexplode("ms").alias("j", "right")).where("i < j")
    s = pairs.groupBy(*key, "i", "j").agg(F.sum(F.col("left.m") * F.col("right.m")).alias("z"), F.sum("left.m").alias("a"), F.sum("right.m").alias("b"))
    return s.groupBy(*key).agg(F.avg(1 - dice_loss(F.col("z"), F.col("a"), F.col("b"))).alias("similarity"))


def mutual_information(ens: DataFrame, key: list[str]) -> DataFrame:
    """negative_mutual_information: minus the mean of H(mean p) - mean H(p), at least 0 before the sign."""
    m = ens.groupBy(*key, "y", "x").agg(F.avg("p").alias("p"), F.avg(entropy_nats(F.col("p"))).alias("h"))
    return m.groupBy(*key).agg((-F.greatest(F.lit(0.0), F.avg(entropy_nats(F.col("p")) - F.col("h")))).alias("negative_mutual_information"))


def probability_variance(ens: DataFrame, key: list[str]) -> DataFrame:
    """negative_variance: minus the mean over pixels of the members' population variance."""
    m = ens.groupBy(*key, "y", "x").agg(F.var_pop("p").alias("v"))
    return m.groupBy(*key).agg((-F.avg("v")).alias("negative_variance"))
