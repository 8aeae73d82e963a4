"""Diagnostics of predicted mask sizes: errors, exact bounds of the size distribution, and PIT values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scores import count_if, hash_unit
from .ranks import equal_bins, places


def size_errors(px: DataFrame, key: list[str]) -> DataFrame:
    """Expected and true mask size and fraction of each image, their signed and absolute differences."""
    s = px.groupBy(*key).agg(F.count("*").alias("n"), F.sum("truth").cast("long").alias("k"), F.sum("p").alias("expected"), F.max("p").alias("top"))
    error = F.col("expected") - F.col("k")
    return s.select(*key, "n", "k", "expected", (F.col("expected") / F.col("n")).alias("expected_fraction"), (F.col("k") / F.col("n")).alias("fraction"), error.alias("signed_error"), F.abs(error).alias("absolute_error"), (1 - F.col("top")).alias("empty_probability"), (F.col("k") == 0).cast("int").alias("empty"))


def cdf_bounds(px: DataFrame, key: list[str]) -> DataFrame:
    """lower = Q(K < k) and upper = Q(K <= k) at the true size k, from the k-th and the next largest probability."""
    w = W.partitionBy(*key)
    ranked = px.select(*key, "p", F.row_number().over(w.orderBy(F.desc("p"))).alias("r"), F.sum("truth").over(w).alias("k"), F.count("*").over(w).alias("n"))
    two = ranked.where("r = k or r = k + 1").groupBy(*key, "k", "n").agg(F.max(F.when(F.col("r") == F.col("k"), F.col("p"))).alias("at"), F.max(F.when(F.col("r") == F.col("k") + 1, F.col("p"))).alias("after"))
    lower = F.when(F.col("k") == 0, F.lit(0.0)).otherwise(1 - F.col("at"))
    upper = F.when(F.col("k") == F.col("n"), F.lit(1.0)).otherwise(1 - F.col("after"))
    return two.select(*key, "k", lower.alias("lower"), upper.alias("upper"))


def pit(px: DataFrame, key: list[str], seed: int, tag: str = "pit") -> DataFrame:
    """Randomised probability integral transform of the true size; the randomiser is a hash of tag, seed and sample."""
    u = hash_unit(F.lit(tag), F.lit(seed), F.col("sample_id"))
    return cdf_bounds(px, key).select("*", u.alias("randomizer"), (F.col("lower") + u * (F.col("upper") - F.col("lower"))).alias("pit"), (F.col("upper") - F.col("lower")).alias("mass"))


def error_summary(rows: DataFrame, cond: list[str], predicted: str, observed: str) -> DataFrame:
    e = F.col(predicted) - F.col(observed)
    return rows.groupBy(*cond).agg(F.avg(predicted).alias("mean_predicted"), F.avg(observed).alias("mean_observed"), F.avg(e).alias("bias"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"))


def ks_uniform(rows: DataFrame, cond: list[str], value: str = "pit") -> DataFrame:
    """ks: the largest distance of the empirical distribution of ``value`` from the uniform one."""
    u = F.col(value)
    r = places(rows.select(*cond, value), cond, [value], "r", "n")
    return r.groupBy(*cond).agg(F.max(F.greatest(F.col("r") / F.col("n") - u, u - (F.col("r") - 1) / F.col("n"))).alias("ks"))


def pit_summary(rows: DataFrame, cond: list[str]) -> DataFrame:
    return rows.groupBy(*cond).agg(F.avg("pit").alias("mean"), F.var_pop("pit").alias("variance"), F.avg(((F.col("pit") < 0.05) | (F.col("pit") > 0.95)).cast("double")).alias("outside"), F.avg((F.col("mass") == 0).cast("double")).alias("zero_mass"), F.avg("mass").alias("mean_mass"), count_if(F.col("mass") == 0).alias("zeros"))


def equal_count_bins(rows: DataFrame, cond: list[str], predicted: str, observed: str, tie: str, bins: int = 10) -> DataFrame:
    """Bins of about equal count in the order of the prediction, ties in that of ``tie``: counts, means and gap."""
    b = equal_bins(rows.select(*cond, predicted, observed, tie), cond, [predicted, tie], bins)
    return b.groupBy(*cond, "bin").agg(F.count("*").alias("n"), F.avg(predicted).alias("mean_predicted"), F.avg(observed).alias("mean_observed"), (F.avg(predicted) - F.avg(observed)).alias("gap"))
