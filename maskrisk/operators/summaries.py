"""Summaries over conditions: reliability, contrasts, sensitivity to the decision threshold, seeds and timings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import written
from . import agreement as A
from . import pixels as P
from . import selective as S
from .ranks import equal_bins, quantiles


def grouped_reliability(rows: DataFrame, cond: list[str], predicted: str, observed: str, tie: str, bins: int = 10) -> DataFrame:
    """bias, mae and rmse over rows, and ece: the count-weighted absolute gap of equal-count bins."""
    e = F.col(predicted) - F.col(observed)
    whole = rows.groupBy(*cond).agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))
    b = equal_bins(rows.select(*cond, predicted, observed, tie), cond, [predicted, tie], bins)
    b = b.groupBy(*cond, "bin").agg(F.count("*").alias("c"), F.abs(F.avg(predicted) - F.avg(observed)).alias("gap"))
    return whole.join(b.groupBy(*cond).agg((F.sum(F.col("c") * F.col("gap")) / F.sum("c")).alias("ece")), cond)


def action_quality(images: DataFrame, cond: list[str], risk: str = "dice_loss") -> DataFrame:
    """Mean loss, shares of empty actions and truths, and the areas of a random and of the best possible order."""
    s = S.summary(images.withColumn("_zero", F.lit(0.0)), cond, "_zero", risk).select(*cond, "oracle", "random")
    return images.groupBy(*cond).agg(F.avg(risk).alias("mean_loss"), F.avg((F.col("action") == 0).cast("double")).alias("empty_actions"), F.avg((F.col("truth_pixels") == 0).cast("double")).alias("empty_truths")).join(s, cond)


def direction(d):
    return F.when(d < 0, "left_lower").when(d > 0, "right_lower").otherwise("tie")


def contrast_table(results: DataFrame, contrasts: DataFrame, cond: list[str]) -> DataFrame:
    """left and right area, their difference and its direction for each contrast (name, left, right, risk) and condition."""
    side = lambda name: results.select(*cond, F.col("risk_name").alias("risk"), F.col("method").alias(name), F.col("aurc").alias(f"{name}_aurc"))
    j = side("left").join(contrasts, ["risk", "left"]).join(side("right"), [*cond, "risk", "right"])
    d = F.col("left_aurc") - F.col("right_aurc")
    return j.select(*cond, "name", "left_aurc", "right_aurc", d.alias("difference"), direction(F.round(d, 9)).alias("direction"))


def gamma_records(px: DataFrame, key: list[str], gammas: list[float], m: int = 8) -> DataFrame:
    """(key, gamma, risk, sdc, ladder): loss and two scores at each decision threshold."""
    out = None
    for g in gammas:
        one = P.image_scores(px, key, g).select(*key, F.lit(g).alias("gamma"), F.col("dice_loss").alias("risk"), "sdc").join(P.dice_ladder(px, key, [m], g), key).withColumnRenamed(f"confidence_dice_m{m}", "ladder")
        out = one if out is None else out.unionByName(one)
    return out


def gamma_contrasts(rows: DataFrame, cond: list[str], left: str, right: str) -> DataFrame:
    """left_aurc, right_aurc and difference for each condition and gamma."""
    a = S.aurc(rows, [*cond, "gamma"], left, "risk").select(*cond, "gamma", F.col("aurc").alias("left_aurc"))
    b = S.aurc(rows, [*cond, "gamma"], right, "risk").select(*cond, "gamma", F.col("aurc").alias("right_aurc"))
    return a.join(b, [*cond, "gamma"]).withColumn("difference", F.round(F.col("left_aurc") - F.col("right_aurc"), 9))


def sensitivity(contrasts: DataFrame, cond: list[str], primary: float = 0.5) -> DataFrame:
    """Change of each difference from the primary threshold's, and what became of its direction."""
    base = contrasts.where(F.col("gamma") == primary).select(*cond, F.col("difference").alias("base"))
    j = contrasts.where(F.col("gamma") != primary).join(base, cond)
    now, was = direction(F.col("difference")), direction(F.col("base"))
    reversal = (now != was) & (now != "tie") & (was != "tie")
    return j.select(*cond, "gamma", (F.col("difference") - F.col("base")).alias("change"), was.alias("was"), now.alias("now"), (now == was).cast("int").alias("retained"), reversal.cast("int").alias("reversal"), ((now != was) & ~reversal).cast("int").alias("tie_transition"))


def gamma_stability(rows: DataFrame, cond: list[str], key: str, score: str, coverages: list[float]) -> DataFrame:
    """Rank agreement and accepted-set overlap of a score between pairs of thresholds."""
    a = rows.select(*cond, key, F.col("gamma").alias("g1"), F.col(score).alias("x"))
    b = rows.select(*cond, key, F.col("gamma").alias("g2"), F.col(score).alias("y"))
    group = [*cond, "g1", "g2"]
    rho = A.spearman(a.join(b, [*cond, key]).where("g1 < g2"), group, "x", "y").select(*group, "rho")
    w = S.accepted(rows, [*cond, "gamma"], score, coverages, key)
    pair = w.select(*cond, key, "coverage", F.col("gamma").alias("g1"), F.col("w").alias("a")).join(w.select(*cond, key, "coverage", F.col("gamma").alias("g2"), F.col("w").alias("b")), [*cond, key, "coverage"]).where("g1 < g2")
    j = pair.groupBy(*group, "coverage").agg((F.sum(F.least("a", "b")) / F.sum(F.greatest("a", "b"))).alias("jaccard"))
    return j.join(rho, group)


def roll_up(changes: DataFrame, group: list[str], name: str) -> DataFrame:
    """Range and median of the changes, counts of outcomes, and the sorted list of reversed conditions."""
    return changes.groupBy(*group).agg(F.min("change").alias("low"), F.max("change").alias("high"), F.percentile("change", F.lit(0.5)).alias("median"), F.sum("retained").cast("long").alias("retained"), F.sum("reversal").cast("long").alias("reversals"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("reversal") == 1, F.col(name)))), ",").alias("reversed"))


def seed_summary(rows: DataFrame, cond: list[str], value: str) -> DataFrame:
    """Mean, range and sample deviation over seeds, with the values in the order of the seeds."""
    return rows.groupBy(*cond).agg(F.count("*").alias("seeds"), F.avg(value).alias("mean"), F.min(value).alias("low"), F.max(value).alias("high"), (F.max(value) - F.min(value)).alias("range"), F.stddev_samp(value).alias("sd"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("seed", F.col(value).alias("v"))))).alias("by_seed"))


def seed_direction(rows: DataFrame, cond: list[str], difference: str, reference: int) -> DataFrame:
    """Majority sign over seeds, whether the reference seed has it, whether any seed reverses it, and the verdict."""
    s = F.signum(F.col(difference)).cast("int")
    g = rows.groupBy(*cond).agg(F.sum((s > 0).cast("int")).alias("up"), F.sum((s < 0).cast("int")).alias("down"), F.max(F.when(F.col("seed") == reference, s)).alias("reference"), F.count("*").alias("seeds"))
    major = F.when(F.col("up") > F.col("down"), 1).when(F.col("down") > F.col("up"), -1).otherwise(0)
    against = F.when(major > 0, F.col("down")).when(major < 0, F.col("up")).otherwise(0)
    return g.select(*cond, "seeds", major.alias("majority"), (F.col("reference") == major).cast("int").alias("reference_agrees"), (against > 0).cast("int").alias("reversal"), ((major != 0) & (against == 0) & (F.col("reference") == major)).cast("int").alias("passes"))


def fine_grid(rows: DataFrame, cond: list[str], coarse: str, fine: str, risk: str) -> DataFrame:
    """Error of the coarse score, rank agreement with the fine one, and the difference of their areas.

    ``rows`` are written once, as each part reads them several times.
    """
    rows = written(rows.select(*cond, *{coarse: 0, fine: 0, risk: 0}), "fine")
    e = A.error_to_reference(rows, cond, coarse, fine)
    gap = S.aurc(rows, cond, coarse, risk).select(*cond, F.col("aurc").alias("a")).join(S.aurc(rows, cond, fine, risk).select(*cond, F.col("aurc").alias("b")), cond).select(*cond, (F.col("a") - F.col("b")).alias("aurc_gap"))
    return e.join(A.spearman(rows, cond, coarse, fine).select(*cond, "rho"), cond).join(A.kendall(rows, cond, coarse, fine), cond).join(gap, cond)


def timings(rows: DataFrame, cond: list[str], method: str, seconds: str, images: int, megapixels: float, base: str) -> DataFrame:
    """Wall-clock range and median, rates, and the ratio of the median to that of a base method."""
    group = [*cond, method]
    t = rows.groupBy(*group).agg(F.count("*").alias("runs"), F.min(seconds).alias("low"), F.max(seconds).alias("high"))
    t = written(t.join(quantiles(rows, group, F.col(seconds), {"median": 0.5}), group), "timings")  # a row for each method
    b = t.where(F.col(method) == base).select(*cond, F.col("median").alias("_base"))
    m = F.col("median")
    return t.join(b, cond, "left").select(*cond, method, "runs", "low", "median", "high", (1000 * m / images).alias("ms_per_image"), (1000 * m / megapixels).alias("ms_per_megapixel"), (images / m).alias("images_per_second"), (m / F.col("_base")).alias("ratio"))


# --- cases ---


def safety_ranks(rows: DataFrame, cond: list[str], scores: dict[str, str]) -> DataFrame:
    """``rows`` with the safety rank of each score (score column to new name): its average rank from 0 (least confident)
    to 1, and 0 in a condition of one row.

    Ranks come from running sums over distinct scores and are joined back, so no task holds a condition. Null scores are
    the least confident, NaN the most. ``rows`` should be a written table, as each score reads it again.
    """
    n = rows.groupBy(*cond).agg(F.count("*").alias("_n"))
    for score, name in scores.items():
        v = written(rows.groupBy(*cond, F.col(score).alias("_v")).agg(F.count("*").alias("_g")), "ranks")
        v = S.running(v, cond, "_v", {"_g": "_above"}).join(n, cond)
        rank = F.col("_n") - F.col("_above") - (F.col("_g") + 1) / 2.0  # the average rank, counted from 0
        v = v.select(*[F.col(c).alias(f"_c_{c}") for c in cond], "_v", F.when(F.col("_n") > 1, rank / (F.col("_n") - 1)).otherwise(F.lit(0.0)).alias(name))
        on = F.col(score).eqNullSafe(F.col("_v"))
        for c in cond:
            on = on & (F.col(c) == F.col(f"_c_{c}"))
        rows = rows.join(v, on).drop("_v", *[f"_c_{c}" for c in cond])
    return rows


def rank_disagreement(rows: DataFrame, cond: list[str], key: str, left: str, right: str) -> DataFrame:
    """left_rank, right_rank (safety ranks of two scores) and gap, their absolute difference, for each row."""
    rows = written(rows.select(*cond, key, F.col(left).alias("_left"), F.col(right).alias("_right")), "scores")
    r = safety_ranks(rows, cond, {"_left": "left_rank", "_right": "right_rank"}).select(*cond, key, "left_rank", "right_rank")
    return r.withColumn("gap", F.abs(F.col("left_rank") - F.col("right_rank")))


def failures(rows: DataFrame, cond: list[str], key: str, losses: dict[str, str], action: str) -> DataFrame:
    """Candidates of two kinds for each loss (risk column to score column): cond, key, kind, loss, risk, value.

    confident_failure: every row, with value the observed risk less what the score predicts. empty_action: rows whose
    ``action`` is 0, with value the observed risk. Rows with a null risk, score or action are no candidates of that kind.
    """
    each = F.array(*[F.struct(F.lit(r).alias("loss"), F.col(r).alias("risk"), F.col(c).alias("score")) for r, c in losses.items()])
    one = rows.select(*cond, key, F.col(action).alias("_a"), F.explode(each).alias("x")).select(*cond, key, "_a", "x.*")
    kinds = F.array(F.struct(F.lit("confident_failure").alias("kind"), (F.col("risk") + F.col("score")).alias("value")), F.struct(F.lit("empty_action").alias("kind"), F.when(F.col("_a") == 0, F.col("risk")).alias("value")))
    return one.select(*cond, key, "loss", "risk", F.explode(kinds).alias("y")).select(*cond, key, "y.kind", "loss", "risk", "y.value").where("value is not null")


def pick_cases(candidates: DataFrame, group: list[str], key: str, kinds: list[str], ties: list[str]) -> DataFrame:
    """One case of each kind in each group, kinds in order: group, kind, status, reason, fallback, value and ``ties``.

    ``candidates`` has group, kind, value and the columns ``ties``, of which ``key`` is one. The largest value wins, the
    smallest ``ties`` of equals. A key that an earlier kind took in the group is taken again only where the kind has no
    other, and fallback is 1 then. Where a kind has no candidate at all, status is unavailable, with a reason.

    Each kind is one aggregation with partial results after a join with what earlier kinds took; rounds are as many as
    kinds, not as groups. ``candidates`` should be a written table, as each round reads it. Rows with a null value are
    no candidates; repeated rows change nothing; an empty table gives an empty table.
    """
    candidates = candidates.where("value is not null")
    groups = candidates.select(*group).distinct()
    taken, out = None, None
    for kind in kinds:
        left = candidates.where(F.col("kind") == kind)
        used = F.lit(0)
        if taken is not None:
            left, used = left.join(taken, [*group, key], "left"), F.coalesce("_used", F.lit(0))
        best = left.groupBy(*group).agg(F.min(F.struct(used.alias("fallback"), (-F.col("value")).alias("_v"), *ties)).alias("b")).select(*group, "b.*")
        now = best.select(*group, key, F.lit(1).alias("_used"))
        taken = now if taken is None else taken.unionByName(now).distinct()
        found = F.col("fallback").isNotNull()
        one = groups.join(best, group, "left").select(
            *group, F.lit(kind).alias("kind"), F.when(found, "selected").otherwise("unavailable").alias("status"), F.when(~found, F.lit(f"no candidate of kind {kind}")).alias("reason"),
            F.coalesce("fallback", F.lit(0)).alias("fallback"), (-F.col("_v")).alias("value"), *ties,
        )
        out = one if out is None else out.unionByName(one)
    return out
