"""Rank agreement of scores, and how distributions of scores differ."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import written
from .ranks import places, quantiles
from .selective import accepted_jaccard, accepted_shares, running


def side_ranks(pairs: DataFrame, cond: list[str], col: str, name: str) -> DataFrame:
    """(cond, col, name): the average rank of each value of a side, the largest first, over pairs with counts ``w``."""
    v = running(pairs.groupBy(*cond, col).agg(F.sum("w").alias("_g")), cond, col, {"_g": "_above"})
    return v.select(*cond, col, (F.col("_above") + (F.col("_g") + 1) / 2.0).alias(name))


def spearman(rows: DataFrame, cond: list[str], x: str, y: str, count: Column | None = None) -> DataFrame:
    """rho of average ranks for each condition; null where a side is constant. Rows with a null side are left out.

    Rows are collapsed to distinct pairs with their counts; ranks of both sides fall, which leaves rho as it is. A row
    stands for ``count`` rows.
    """
    pairs = rows.select(*cond, F.col(x).alias("x"), F.col(y).alias("y"), (F.lit(1) if count is None else count).alias("c")).where("x is not null and y is not null")
    pairs = written(pairs.groupBy(*cond, "x", "y").agg(F.sum("c").alias("w")), "pairs")
    ranked = pairs.join(side_ranks(pairs, cond, "x", "rx"), [*cond, "x"]).join(side_ranks(pairs, cond, "y", "ry"), [*cond, "y"])
    w, rx, ry = F.col("w"), F.col("rx"), F.col("ry")
    varies = (F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))
    mid = pairs.groupBy(*cond).agg(((F.sum("w") + 1) / 2.0).alias("mid"), F.sum("w").alias("n"))
    a, b = rx - F.col("mid"), ry - F.col("mid")
    s = ranked.join(mid, cond).groupBy(*cond, "n").agg(varies.alias("v"), F.sum(w * a * b).alias("c"), F.sqrt(F.sum(w * a * a) * F.sum(w * b * b)).alias("d"))
    return s.select(*cond, F.when(F.col("v"), F.col("c") / F.col("d")).alias("rho"), "n")


def dense(rows: DataFrame, cond: list[str], col: str, name: str) -> DataFrame:
    """``rows`` with ``name``: how many distinct values of the condition are above, from 0; no task holds a condition."""
    v = rows.groupBy(*cond, F.col(col).alias("_v")).agg(F.lit(1).alias("_one"))
    v = running(v, cond, "_v", {"_one": name}).withColumnRenamed("_v", col)
    return rows.join(v.select(*cond, col, F.col(name).cast("long").alias(name)), [*cond, col])


def discordant_counts(rows: DataFrame, cond: list[str], x: str, y: str, radix: int = 4, count: Column | None = None) -> DataFrame:
    """For each condition the numbers of concordant and discordant pairs, and of pairs tied in x or in y.

    Rows are collapsed to distinct (x, y), and y becomes a dense rank. Any two different ranks agree in their leading
    digits and part at one digit, so each pair is counted at one level: there, among the rows of equal leading digits, it
    is concordant if the larger digit goes with the larger x. With counts for each digit and x, that takes running sums
    over x. Rows are sent once for each level, as many as the rank has digits; no pairs are formed. Rows with a null or
    NaN in x or y are left out; an empty table gives no rows. A row stands for ``count`` rows.
    """
    good = F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan(F.col("x").cast("double")) & ~F.isnan(F.col("y").cast("double"))
    d = rows.select(*cond, F.col(x).alias("x"), F.col(y).alias("y"), (F.lit(1) if count is None else count).alias("c")).where(good).groupBy(*cond, "x", "y").agg(F.sum("c").alias("c"))
    d = dense(d, cond, "y", "ry").withColumnRenamed("x", "rx")
    depth = F.ceil(F.log(float(radix), F.greatest(F.max("ry"), F.lit(1)) + 1.0) + 1e-9).cast("int")
    d = written(d, "ranks")
    each = d.join(d.groupBy(*cond).agg(depth.alias("depth")), cond)
    each = each.withColumn("level", F.explode(F.sequence(F.lit(1), "depth")))
    unit = F.pow(F.lit(float(radix)), F.col("level") - 1).cast("long")
    each = each.withColumns({"digit": F.floor(F.col("ry") / unit) % radix, "lead": F.floor(F.col("ry") / (unit * radix))})
    group, counts = [*cond, "level", "lead"], [f"c{k}" for k in range(radix)]
    t = each.groupBy(*group, "rx").agg(*[F.sum(F.when(F.col("digit") == k, F.col("c")).otherwise(0)).alias(c) for k, c in enumerate(counts)])
    t = running(t, group, "rx", {c: f"{c}_above" for c in counts})
    # ``ry`` counts from the largest y, so of two rows the one with the larger x is concordant if its digit is smaller.
    pairs = lambda keep: sum((F.col(counts[i]) * F.col(f"{counts[j]}_above") for i in range(radix) for j in range(radix) if keep(i, j)), F.lit(0))
    pairs = t.groupBy(*cond).agg(F.sum(pairs(lambda i, j: j < i)).alias("con"), F.sum(pairs(lambda i, j: j > i)).alias("dis"))

    def ties(cols, name):
        t = d.groupBy(*cond, *cols).agg(F.sum("c").alias("c"))
        return t.groupBy(*cond).agg(F.sum(F.expr("c * (c - 1) div 2")).alias(name), *([F.sum("c").alias("n")] if name == "tie_x" else []))

    return ties(["rx"], "tie_x").join(ties(["ry"], "tie_y"), cond).join(pairs, cond, "left").na.fill(0, ["con", "dis"])


def kendall(rows: DataFrame, cond: list[str], x: str, y: str, radix: int = 4, count: Column | None = None) -> DataFrame:
    """tau-b for each condition; null where a side is constant. A row stands for ``count`` rows."""
    s = discordant_counts(rows, cond, x, y, radix, count)
    all_ = F.expr("n * (n - 1) div 2")
    room = F.sqrt((all_ - F.col("tie_x")).cast("double")) * F.sqrt((all_ - F.col("tie_y")).cast("double"))
    return s.select(*cond, F.when(room > 0, (F.col("con") - F.col("dis")) / room).alias("tau"))


def score_agreement(rows: DataFrame, cond: list[str], key: str, methods: list[str], coverages: list[float]) -> DataFrame:
    """Spearman, tau-b and the overlap of accepted sets for each pair of methods in each condition; ``key`` names a row.

    A row's share of an accepted set depends on its score alone, so all three come from distinct pairs of scores and
    their counts.
    """
    names = sorted(methods)
    rows = written(rows.select(*cond, key, *names), "scores")
    sides = [F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(a).alias("x"), F.col(b).alias("y")) for i, a in enumerate(names) for b in names[i + 1 :]]
    group = [*cond, "left", "right"]
    named = rows.dropna(subset=[*cond, key]).select(*cond, F.explode(F.array(*sides)).alias("s")).select(*cond, "s.*")
    both = written(named.groupBy(*group, "x", "y").agg(F.count("*").alias("c")), "both")
    w = written(accepted_shares(rows.select(*cond, *names).unpivot(cond, names, "method", "score"), [*cond, "method"], "score", coverages), "shares")
    side = lambda name, score, share: w.select(*cond, "coverage", F.col("method").alias(name), F.col("score").alias(score), F.col("w").alias(share))
    pair = both.join(side("left", "x", "a"), [*cond, "left", "x"]).join(side("right", "y", "b"), [*cond, "coverage", "right", "y"])
    top = F.sum(F.col("c") * F.greatest("a", "b"))
    jac = pair.groupBy(*group, "coverage").agg(F.when(top <= 0, F.lit(1.0)).otherwise(F.sum(F.col("c") * F.least("a", "b")) / top).alias("j"))
    jac = jac.groupBy(*group).pivot("coverage", [float(c) for c in coverages]).agg(F.first("j"))
    jac = jac.select(*group, *[F.col(f"`{float(c)}`").alias(f"jaccard_{int(100 * c)}") for c in coverages])
    return spearman(both, group, "x", "y", F.col("c")).select(*group, "rho").join(kendall(both, group, "x", "y", count=F.col("c")), group).join(jac, group)


def error_to_reference(rows: DataFrame, cond: list[str], score: str, reference: str) -> DataFrame:
    """Absolute differences from a reference score: mean, median, 95th percentile, largest, share of equal values."""
    e = F.abs(F.col(score) - F.col(reference))
    rows = written(rows.select(*cond, e.alias("_e"), (F.col(score) == F.col(reference)).cast("double").alias("_same")), "errors")
    own = rows.groupBy(*cond).agg(F.avg("_e").alias("mean"), F.max("_e").alias("largest"), F.avg("_same").alias("equal_share"))
    return own.join(quantiles(rows, cond, F.col("_e"), {"median": 0.5, "p95": 0.95}), cond).select(*cond, "mean", "median", "p95", "largest", "equal_share")


def wasserstein(rows: DataFrame, cond: list[str], x: str, y: str) -> DataFrame:
    """The empirical distance of two samples of equal size: the mean difference of values of equal rank."""
    a = places(rows.select(*cond, F.col(x).alias("a")), cond, ["a"], "r").drop("of")
    b = places(rows.select(*cond, F.col(y).alias("b")), cond, ["b"], "r").drop("of")
    return a.join(b, [*cond, "r"]).groupBy(*cond).agg(F.avg(F.abs(F.col("a") - F.col("b"))).alias("distance"), F.count("*").alias("n"))


def strata_summary(rows: DataFrame, cond: list[str], value, stratum, strata: list[str]) -> DataFrame:
    """Count, mean, mean absolute value, root mean square and three quantiles of ``value``, over all rows and for every stratum.

    A stratum without rows has the count 0 and nulls.
    """
    each = rows.select(*cond, value.alias("v"), F.explode(F.array(F.lit("all"), stratum)).alias("stratum"))
    each = written(each.where("stratum is not null"), "strata")
    group = [*cond, "stratum"]
    got = each.groupBy(*group).agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.avg(F.abs("v")).alias("mean_absolute"), F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rmse"))
    got = got.join(quantiles(each, group, F.col("v"), {"p10": 0.1, "median": 0.5, "p90": 0.9}), group)
    every = rows.select(*cond).distinct().withColumn("stratum", F.explode(F.array(*[F.lit(x) for x in ("all", *strata)])))
    return every.join(got, [*cond, "stratum"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
