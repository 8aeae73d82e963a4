"""Selective risk: tie-aware areas under risk-coverage curves and what is accepted at a coverage.

Scores are larger where more confident; lower areas are better. Rows are collapsed to distinct scores before any window,
so a window sees ties once, and every window is within a group.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import written
from .ranks import places

#: Terms of the harmonic sum that are looked up; beyond, its expansion is exact to a double.
TERMS = 64
SUMS = np.array([0.0, *accumulate(1 / i for i in range(1, TERMS + 1))])


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n for each whole n >= 0."""
    x = n.cast("double")
    large = F.ln(x) + F.lit(0.5772156649015329) + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * F.pow(x, F.lit(4.0))) - 1 / (252 * F.pow(x, F.lit(6.0)))
    table = F.array(*[F.lit(float(h)) for h in accumulate((1 / i for i in range(1, TERMS + 1)), initial=0.0)])  # a constant
    return F.when(n <= TERMS, F.get(table, F.greatest(n, F.lit(0)).cast("int"))).otherwise(large)


def harmonics(n: np.ndarray) -> np.ndarray:
    """``harmonic`` of an array."""
    x = np.maximum(n, 1).astype(float)
    x2 = x * x
    x4 = x2 * x2
    large = np.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x2) + 1 / (120 * x4) - 1 / (252 * x4 * x2)
    return np.where(n <= TERMS, SUMS[np.minimum(n, TERMS)], large)


def running(rows: DataFrame, group: list[str], order: str, sums: dict[str, str], buckets: int = 64) -> DataFrame:
    """``rows`` with sums over all rows of the group with a larger ``order``, of which each group has distinct values.

    Two levels, so that no task holds a group: each group is cut at approximate quantiles of ``order`` into stretches, a
    window runs within a stretch, and the totals of the stretches before it, ``buckets`` for a group, are added. Null
    orders come last, NaN first.
    """
    cuts = rows.groupBy(*group).agg(F.percentile_approx(F.nanvl(F.col(order).cast("double"), F.lit(None).cast("double")), [k / buckets for k in range(1, buckets)], 16 * buckets).alias("_cuts"))
    place = F.when(F.col(order).isNull(), F.lit(buckets - 1)).otherwise(F.coalesce(F.size(F.filter("_cuts", lambda e: e > F.col(order))), F.lit(0)))
    rows = rows.join(cuts, group).withColumn("_bucket", place).drop("_cuts")
    total = rows.groupBy(*group, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    before = W.partitionBy(*group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    total = total.select(*group, "_bucket", *[F.sum(f"_t_{c}").over(before).alias(f"_b_{c}") for c in sums])
    inner = W.partitionBy(*group, "_bucket").orderBy(F.desc(order)).rowsBetween(W.unboundedPreceding, -1)
    out = rows.withColumns({name: F.coalesce(F.sum(c).over(inner), F.lit(0)) for c, name in sums.items()}).join(total, [*group, "_bucket"])
    return out.withColumns({name: F.col(name) + F.coalesce(f"_b_{c}", F.lit(0)) for c, name in sums.items()}).drop("_bucket", *[f"_b_{c}" for c in sums])


def tie_groups(rows: DataFrame, group: list[str], score: str, risk: str, weight: str | None = None) -> DataFrame:
    """For each group and distinct score: g rows, their risk s, and the rows and risk of all larger scores, before and sum."""
    w_ = F.col(weight) if weight else F.lit(1)
    t = rows.groupBy(*group, F.col(score).alias("score")).agg(F.sum(w_).alias("g"), F.sum(w_ * F.col(risk)).alias("s")).where("g > 0")
    return running(t, group, "score", {"g": "before", "s": "sum"})


def aurc(rows: DataFrame, group: list[str], score: str, risk: str, weight: str | None = None) -> DataFrame:
    """aurc for each group: the mean over prefixes of their mean risk, averaged over all orders within ties."""
    t = tie_groups(rows, group, score, risk, weight)
    mu = F.col("s") / F.col("g")
    step = F.col("s") + (F.col("sum") - F.col("before") * mu) * (harmonic(F.col("before") + F.col("g")) - harmonic(F.col("before")))
    return t.withColumn("step", step).groupBy(*group).agg((F.sum("step") / F.sum("g")).alias("aurc"), F.sum("g").alias("n"))


def limits(rows: DataFrame, group: list[str], risk: str) -> DataFrame:
    """oracle (the area with the risk itself as score) and random (mean risk): neither depends on a score."""
    oracle = aurc(rows.withColumn("_o", -F.col(risk)), group, "_o", risk).select(*group, F.col("aurc").alias("oracle"))
    return oracle.join(rows.groupBy(*group).agg(F.avg(risk).alias("random")), group)


def between(own: DataFrame, bounds: DataFrame, on: list[str], group: list[str]) -> DataFrame:
    """The areas of ``own`` with their limits: excess over the oracle, and normalized (null where random is the oracle)."""
    room = F.col("random") - F.col("oracle")
    close = F.abs(room) <= F.lit(1e-15)
    return own.join(bounds, on).select(*group, "n", "aurc", "oracle", "random", (F.col("aurc") - F.col("oracle")).alias("excess"), F.when(close, F.lit(None)).otherwise((F.col("aurc") - F.col("oracle")) / room).alias("normalized"))


def summary(rows: DataFrame, group: list[str], score: str, risk: str) -> DataFrame:
    """aurc, oracle, random, excess and normalized for each group, as in ``limits`` and ``between``."""
    return between(aurc(rows, group, score, risk), limits(rows, group, risk), group, group)


def plain_aurc(rows: DataFrame, group: list[str], score: str, risk: str, tie: str) -> DataFrame:
    """The same area in one fixed order: ties stay in the order of ``tie``.

    Rows are dealt to ranges of that order, so no task holds a group. NaN scores come first and null ones last; rows of
    null risk stand in the order but in no mean.
    """
    s, x = F.col(score).cast("double"), F.col(risk).cast("double")
    one = rows.select(*group, s.alias("_s"), F.col(tie).alias("_tie"), x.alias("_x"), x.isNotNull().cast("long").alias("_c"))
    ordered = places(one, group, [F.col("_s").isNull(), F.coalesce(~F.isnan("_s"), F.lit(True)), -F.col("_s"), "_tie"], sums={"_x": "_sum", "_c": "_count"})
    return ordered.groupBy(*group).agg(F.avg(F.when(F.col("_count") > 0, F.col("_sum") / F.col("_count"))).alias("aurc"))


def curve(rows: DataFrame, group: list[str], score: str, risk: str) -> DataFrame:
    """Expected risk at each number of accepted rows, j from 1 on, with the coverage.

    The distinct scores are written, so that the plan of a curve does not repeat theirs.
    """
    t = written(tie_groups(rows, group, score, risk), "ties")
    each = t.join(t.groupBy(*group).agg(F.sum("g").alias("n")), group).withColumn("i", F.explode(F.sequence(F.lit(1), F.col("g").cast("int"))))
    j = F.col("before") + F.col("i")
    return each.select(*group, j.cast("long").alias("j"), (j / F.col("n")).alias("coverage"), ((F.col("sum") + F.col("i") * F.col("s") / F.col("g")) / j).alias("risk"))


def accepted_shares(rows: DataFrame, group: list[str], score: str, coverages: list[float]) -> DataFrame:
    """(group, score, coverage, w): how much of a row of each distinct score is accepted at each coverage."""
    t = rows.groupBy(*group, F.col(score).alias("score")).agg(F.count("*").alias("g"))
    t = running(t, group, "score", {"g": "before"}).join(t.groupBy(*group).agg(F.sum("g").alias("n")), group)
    c = t.withColumn("coverage", F.explode(F.array(*[F.lit(float(x)) for x in coverages])))
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("coverage") * F.col("n") - F.col("before")) / F.col("g")))
    return c.select(*group, "score", "coverage", share.alias("w"))


def accepted(rows: DataFrame, group: list[str], score: str, coverages: list[float], row: str) -> DataFrame:
    """w for each row and coverage: how much of it is accepted, so that the accepted mass is coverage times n."""
    c = accepted_shares(rows, group, score, coverages)
    return rows.select(*group, row, F.col(score).alias("score")).join(c, [*group, "score"]).select(*group, row, "coverage", "w")


def accepted_jaccard(left: DataFrame, right: DataFrame, on: list[str], group: list[str]) -> DataFrame:
    """jaccard of two accepted sets with fractional members: sum of the smaller over sum of the larger share."""
    both = left.select(*on, F.col("w").alias("a")).join(right.select(*on, F.col("w").alias("b")), on)
    top = F.sum(F.greatest("a", "b"))
    return both.groupBy(*group).agg(F.when(top <= 0, F.lit(1.0)).otherwise(F.sum(F.least("a", "b")) / top).alias("jaccard"))


def matrix(rows: DataFrame, cond: list[str], key: str, methods: list[str], risks: list[str]) -> DataFrame:
    """``summary`` of every method for every risk in each condition; limits are computed once for each risk.

    Rows are written once, as both parts read them; ``key`` names a row and is not needed for areas.
    """
    rows = written(rows.select(*cond, *methods, *risks), "scores")
    each = rows.unpivot([*cond, *methods], risks, "risk_name", "risk")
    of = [*cond, "risk_name"]
    long = each.unpivot([*of, "risk"], methods, "method", "score")
    return between(aurc(long, [*of, "method"], "score", "risk"), limits(each, of, "risk"), of, [*of, "method"])


def best(results: DataFrame, group: list[str]) -> DataFrame:
    """``results`` with best: whether the area is the smallest of its group; ties are all best."""
    return results.withColumn("best", F.col("aurc") == F.min("aurc").over(W.partitionBy(*group)))


def regret(rows: DataFrame, group: list[str], batch: Column, score: str, risk: str) -> DataFrame:
    """Mean excess area over batches of a group, and its standard error."""
    per = summary(rows.withColumn("batch", batch), [*group, "batch"], score, risk)
    return per.groupBy(*group).agg(F.avg("excess").alias("regret"), (F.stddev_samp("excess") / F.sqrt(F.count("*").cast("double"))).alias("standard_error"), F.count("*").alias("batches"))
