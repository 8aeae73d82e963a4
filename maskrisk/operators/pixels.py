"""Per-image scores and losses of probability maps: one aggregation over pixels, no mask is built.

A pixel table has the key columns, y, x, p (double in [0, 1]) and truth (0 or 1). The action is p >= gamma.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import count_if, dice_loss, entropy_bits, entropy_nats_clipped, soft_dice, sum_if


def hard_action(px: DataFrame, gamma: float = 0.5) -> DataFrame:
    """``px`` with a (0 or 1): whether p reaches gamma; ties are foreground."""
    return px.withColumn("a", (F.col("p") >= gamma).cast("int"))


def image_scores(px: DataFrame, key: list[str], gamma: float = 0.5) -> DataFrame:
    """One row for each image: sizes, confusion counts, losses of the action, and the confidence baselines."""
    p, truth = F.col("p"), F.col("truth")
    a, bits = p >= gamma, entropy_bits(p)
    s = px.groupBy(*key).agg(
        F.count("*").alias("n"), count_if(a).alias("action"), F.sum("truth").cast("long").alias("truth_pixels"),
        count_if(a & (truth == 1)).alias("tp"), count_if(a & (truth == 0)).alias("fp"), count_if(~a & (truth == 1)).alias("fn"), count_if(~a & (truth == 0)).alias("tn"),
        (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.sum("p").alias("sum_p"), sum_if(a, p).alias("sum_p_in"), F.max("p").alias("max_p"), F.min("p").alias("min_p"),
        F.avg(F.greatest(p, 1 - p)).alias("mean_max_probability"), (-F.avg(entropy_nats_clipped(p))).alias("negative_mean_entropy"),
        F.coalesce(-F.avg(F.when(a, bits)), F.lit(-1.0)).alias("foreground_entropy"), F.avg((p - truth) * (p - truth)).alias("brier"),
        F.percentile(bits, F.lit(0.5)).alias("_median"), F.min(bits).alias("_low"), F.max(bits).alias("_high"),
    )
    n, union = F.col("n"), F.col("tp") + F.col("fp") + F.col("fn")
    return s.select(
        *key, "n", "action", "truth_pixels", "tp", "fp", "fn", "tn", "sum_p", "sum_p_in", "max_p", "min_p", "height", "width",
        (F.col("action") / n).alias("action_fraction"), (F.col("truth_pixels") / n).alias("truth_fraction"),
        F.sqrt((F.col("height") * F.col("height") + F.col("width") * F.col("width")).cast("double")).alias("diagonal"),
        ((F.col("fp") + F.col("fn")) / n).alias("hard_error"), "mean_max_probability", "negative_mean_entropy", "foreground_entropy", "brier",
        F.when(F.col("_high") == 0, F.lit(0.0)).otherwise(-(F.col("_median") + F.col("_low")) / F.col("_high")).alias("mmmc"),
        soft_dice(F.col("sum_p_in"), F.col("sum_p"), F.col("action")).alias("sdc"),
        dice_loss(F.col("tp"), F.col("action"), F.col("truth_pixels")).alias("dice_loss"),
        F.when(union == 0, F.lit(0.0)).otherwise(1 - F.col("tp") / union).alias("jaccard_distance"),
    )


def quantile_foreground_ratio(px: DataFrame, key: list[str], gamma: float = 0.5) -> DataFrame:
    """qfr: minus the mean of the entropies that reach their (1 - action fraction) quantile, ties kept.

    The level differs by image, so the quantile is interpolated between the two order statistics at its place.
    """
    w = W.partitionBy(*key)
    h = px.select(*key, entropy_bits(F.col("p")).alias("h"), (F.col("p") >= gamma).cast("int").alias("a"))
    h = h.withColumns({"n": F.count("*").over(w), "s": F.sum("a").over(w), "r": F.row_number().over(w.orderBy("h")) - 1})
    place = (F.col("n") - 1) * (F.col("n") - F.col("s"))
    at = h.select(*key, "h", "r", F.floor(place / F.col("n")).alias("lo"), (F.pmod(place, F.col("n")) / F.col("n")).alias("part"))
    q = at.groupBy(*key).agg(F.max(F.when(F.col("r") == F.col("lo"), F.col("h"))).alias("a"), F.max(F.when(F.col("r") == F.col("lo") + 1, F.col("h"))).alias("b"), F.max("part").alias("part"))
    q = q.select(*key, F.when(F.col("part") == 0, F.col("a")).otherwise(F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"))
    return at.join(q, key).where("h >= quantile").groupBy(*key).agg((-F.avg("h")).alias("qfr"))


def patch_maximum(px: DataFrame, key: list[str], patch: int) -> DataFrame:
    """plm: minus the largest mean entropy of a square patch inside the image, by two moving sums."""
    h = px.select(*key, "y", "x", entropy_bits(F.col("p")).alias("h"))
    rows = F.sum("h").over(W.partitionBy(*key, "y").orderBy("x").rowsBetween(1 - patch, 0))
    cols = F.sum("r").over(W.partitionBy(*key, "x").orderBy("y").rowsBetween(1 - patch, 0))
    sums = h.withColumn("r", rows).withColumn("s", cols).where((F.col("x") >= patch - 1) & (F.col("y") >= patch - 1))
    return sums.groupBy(*key).agg((-F.max(F.col("s") / (patch * patch))).alias("plm"))


def common_scores(px: DataFrame, key: list[str], gamma: float = 0.5, patch: int = 10) -> DataFrame:
    """Every common score and loss of an image as one wide row."""
    return image_scores(px, key, gamma).join(quantile_foreground_ratio(px, key, gamma), key, "left").join(patch_maximum(px, key, patch), key, "left")


# --- level sets by counts ---


def nodes(m: int) -> list[float]:
    """Midpoint nodes (k + 0.5) / m; their weights are 1 / m."""
    return [(k + 0.5) / m for k in range(m)]


def count_ladders(px: DataFrame, key: list[str], at: list[float], gamma: float = 0.5) -> DataFrame:
    """For each image arrays z and w: pixels that reach each node inside and outside the action; and action, n.

    One conditional sum for each node in one aggregation, so pixels are never multiplied by nodes.
    """
    p = F.col("p")
    a = p >= gamma
    s = px.groupBy(*key).agg(
        F.array(*[count_if(a & (p >= t)) for t in at]).alias("z"), F.array(*[count_if(~a & (p >= t)) for t in at]).alias("w"),
        count_if(a).alias("action"), F.count("*").alias("n"), sum_if(a, p).alias("sum_in"), sum_if(~a, p).alias("sum_out"),
    )
    return s


def node_losses(ladders: DataFrame) -> DataFrame:
    """``ladders`` with loss: the Dice loss of each node's level set against the action."""
    size = F.col("action")
    return ladders.withColumn("loss", F.zip_with("z", "w", lambda z, w: dice_loss(z, z + w, size)))


def mean_of(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x) / F.size(array)


def place(p: Column, at: list[float]) -> Column:
    """How many of the ascending nodes p reaches, by halving."""

    def cut(low: int, high: int) -> Column:
        middle = (low + high) // 2
        return F.lit(low) if low == high else F.when(p >= at[middle], cut(middle + 1, high)).otherwise(cut(low, middle))

    return cut(0, len(at))


def dice_ladder(px: DataFrame, key: list[str], ms: list[int], gamma: float = 0.5) -> DataFrame:
    """confidence_dice_m{m} for several m at once: losses at the union of their nodes, averaged for each.

    Pixels are counted by how many nodes they reach. Nodes between two such numbers have one level set, so a running sum
    gives its loss, and each rule takes it as often as it has nodes there.
    """
    union = sorted({t for m in ms for t in nodes(m)})
    a = F.col("p") >= gamma
    g = px.groupBy(*key, place(F.col("p"), union).alias("_k")).agg(count_if(a).alias("i"), count_if(~a).alias("o"))
    by, down = W.partitionBy(*key), W.partitionBy(*key).orderBy(F.desc("_k"))
    upto = down.rowsBetween(W.unboundedPreceding, 0)
    g = g.withColumns({"z": F.sum("i").over(upto), "w": F.sum("o").over(upto), "under": F.coalesce(F.lead("_k").over(down), F.lit(0)), "action": F.sum("i").over(by), "top": F.max("_k").over(by)})
    loss, empty = dice_loss(F.col("z"), F.col("z") + F.col("w"), F.col("action")), F.when(F.col("action") > 0, 1.0).otherwise(0.0)
    out = []
    for m in ms:
        own, reached = set(nodes(m)), [0]
        for t in union:
            reached.append(reached[-1] + (t in own))
        upon = F.array(*map(F.lit, reached))
        below = lambda c, upon=upon: F.get(upon, F.col(c))
        out.append((-(F.sum(loss * (below("_k") - below("under"))) + F.max(empty * (m - below("top")))) / m).alias(f"confidence_dice_m{m}"))
    return g.groupBy(*key).agg(*out)


def level_set_risk(px: DataFrame, key: list[str], weights: dict[float, float], loss, gamma: float = 0.5) -> DataFrame:
    """risk: the weighted sum over thresholds of any loss of the level set against the action.

    ``loss`` is a function of columns (overlap, level size, action size). Thresholds lie in (0, 1) and rise; weights are
    not negative and sum to 1.
    """
    at = checked_nodes(weights)
    ladders = count_ladders(px, key, at, gamma)
    size = F.col("action")
    each = F.zip_with("z", "w", lambda z, w: loss(z, z + w, size))
    total = F.aggregate(F.zip_with(each, F.array(*[F.lit(float(weights[t])) for t in at]), lambda x, v: x * v), F.lit(0.0), lambda s, x: s + x)
    return ladders.select(*key, total.alias("risk"))


def mask_risk(px: DataFrame, key: list[str], weights: dict[float, float], loss, gamma: float = 0.5) -> DataFrame:
    """risk: the weighted sum over thresholds of any loss of two masks, as one that needs places and not only counts.

    ``loss`` turns (masks, key) into rows of key and loss; masks has key, y, x, level and action, both 0 or 1, and its
    key is that of the image and t, the threshold. Every pixel comes once for each threshold: where counts suffice,
    ``level_set_risk`` is cheaper. Thresholds and weights are as there.
    """
    at = checked_nodes(weights)
    each = px.select(*key, "y", "x", "p", F.explode(F.array(*[F.lit(float(t)) for t in at])).alias("t"))
    masks = each.select(*key, "t", "y", "x", (F.col("p") >= F.col("t")).cast("int").alias("level"), (F.col("p") >= gamma).cast("int").alias("action"))
    weight = F.element_at(F.create_map(*[F.lit(float(x)) for t in at for x in (t, weights[t])]), F.col("t"))
    return loss(masks, [*key, "t"]).groupBy(*key).agg(F.sum(weight * F.col("loss")).alias("risk"))


def checked_nodes(weights: dict[float, float]) -> list[float]:
    """The thresholds in order; they lie in (0, 1), and weights are not negative and sum to 1."""
    at = sorted(weights)
    if not at or at[0] <= 0 or at[-1] >= 1 or min(weights.values()) < 0 or abs(sum(weights.values()) - 1) > 1e-9:
        raise ValueError("thresholds must lie in (0, 1), weights must not be negative and must sum to 1")
    return at


def exact_dice(px: DataFrame, key: list[str], gamma: float = 0.5) -> DataFrame:
    """confidence_dice_exact: minus the Dice risk integrated over all thresholds, from distinct probabilities."""
    a = F.col("p") >= gamma
    groups = px.groupBy(*key, "p").agg(F.count("*").alias("c"), count_if(a).alias("i"))
    down = W.partitionBy(*key).orderBy(F.desc("p"))
    upto = down.rowsBetween(W.unboundedPreceding, 0)
    g = groups.withColumns({"size": F.sum("c").over(upto), "inter": F.sum("i").over(upto), "under": F.coalesce(F.lead("p").over(down), F.lit(0.0)), "action": F.sum("i").over(W.partitionBy(*key)), "top": F.max("p").over(W.partitionBy(*key))})
    inside = F.when(F.col("p") > 0, (F.col("p") - F.col("under")) * (1 - 2 * F.col("inter") / (F.col("size") + F.col("action")))).otherwise(F.lit(0.0))
    above = (1 - F.max("top")) * F.max(F.when(F.col("action") > 0, 1.0).otherwise(0.0))
    return g.groupBy(*key).agg((-(F.sum(inside) + above)).alias("confidence_dice_exact"))


def count_study(px: DataFrame, key: list[str], m: int = 32, gamma: float = 0.5) -> DataFrame:
    """Shared and two-block Dice confidence, count moments, their second-order expansion, and SDC (1 where undefined)."""
    s = node_losses(count_ladders(px, key, nodes(m), gamma))
    size = F.col("action")
    two = F.aggregate(F.transform("z", lambda z: F.aggregate(F.transform("w", lambda w: dice_loss(z, z + w, size)), F.lit(0.0), lambda t, x: t + x)), F.lit(0.0), lambda t, x: t + x)
    zm, wm = mean_of(F.col("z")), mean_of(F.col("w"))
    s = s.withColumns({"zm": zm, "wm": wm})
    var = lambda c, mean: mean_of(F.transform(c, lambda x: (x - F.col(mean)) * (x - F.col(mean))))
    s = s.withColumns({"var_z": var("z", "zm"), "var_w": var("w", "wm"), "cov": mean_of(F.zip_with("z", "w", lambda z, w: (z - F.col("zm")) * (w - F.col("wm"))))})
    d = size + F.col("sum_in") + F.col("sum_out")
    a, z, w = size, F.col("sum_in"), F.col("sum_out")
    correction = (-2 * (a + w) * F.col("var_z") + 2 * (z - a - w) * F.col("cov") + 2 * z * F.col("var_w")) / (d * d * d)
    return s.select(
        *key, "n", "action", "z", "w", (-mean_of(F.col("loss"))).alias("shared_dice"), (-(two / (m * m))).alias("two_block_dice"),
        F.col("zm").alias("mean_overlap"), F.col("wm").alias("mean_outside"), "var_z", "var_w", "cov", "sum_in", "sum_out",
        F.when(d == 0, F.lit(1.0)).otherwise(2 * z / d).alias("sdc"), F.when(d == 0, F.lit(1.0)).otherwise(2 * z / d + correction).alias("second_order"),
    )


def sdc_bound(px: DataFrame, key: list[str], m: int = 32, gamma: float = 0.5) -> DataFrame:
    """For each image with an action: |exact - plug-in| Dice risk, its bound by count dispersion, slack and ratio."""
    s = count_study(px, key, m, gamma).join(exact_dice(px, key, gamma), key).where("action > 0")
    error = F.abs(-F.col("confidence_dice_exact") - (1 - F.col("sdc")))
    bound = 2 * F.sqrt("var_z") / F.col("action") + F.sqrt("var_w") / (2 * F.col("action"))
    s = s.select(*key, "action", error.alias("error"), bound.alias("bound"))
    return s.select("*", (F.col("bound") - F.col("error")).alias("slack"), F.when((F.col("bound") == 0) & (F.col("error") == 0), F.lit(0.0)).otherwise(F.col("error") / F.col("bound")).alias("ratio"), (F.col("bound") - F.col("error") >= -64 * 2.0**-52 * F.greatest(F.lit(1.0), "bound", "error")).alias("holds"))


def empty_chance(px: DataFrame, key: list[str], blocks: str | None = None) -> DataFrame:
    """Chance of an empty mask: one shared threshold, independent pixels, independent blocks, an antithetic pair."""
    p = F.col("p")
    none = F.max(F.when(p >= 1, 1).otherwise(0)) == 1
    flat = px.groupBy(*key).agg((1 - F.max("p")).alias("shared"), F.when(none, F.lit(0.0)).otherwise(F.exp(F.sum(F.when(p < 1, F.log1p(-p)).otherwise(F.lit(0.0))))).alias("independent"))
    if blocks is None:
        return flat
    b = px.groupBy(*key, blocks).agg(F.max("p").alias("top"))
    full = F.max(F.when(F.col("top") >= 1, 1).otherwise(0)) == 1
    first, second = F.max(F.when(F.col(blocks) % 2 == 0, F.col("top"))), F.max(F.when(F.col(blocks) % 2 == 1, F.col("top")))
    by = b.groupBy(*key).agg(F.when(full, F.lit(0.0)).otherwise(F.exp(F.sum(F.when(F.col("top") < 1, F.log1p(-F.col("top"))).otherwise(F.lit(0.0))))).alias("block"), F.greatest(F.lit(0.0), 1 - F.coalesce(first, F.lit(0.0)) - F.coalesce(second, F.lit(0.0))).alias("antithetic"))
    return flat.join(by, key)
