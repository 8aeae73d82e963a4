"""Joining score tables of one cohort: identity is checked exactly before anything is put side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import selective as S


def _checked(left: DataFrame, right: DataFrame, key: list[str], shared: list[str]) -> DataFrame:
    """The right side's rows on the left's keys; a row that only one side has, or an unequal shared field, is an error."""
    r = right.select(*key, *[F.col(c) if c not in shared else F.col(c).alias(f"_r_{c}") for c in right.columns if c not in key], F.lit(1).alias("_right"))
    j = left.withColumn("_left", F.lit(1)).join(r, key, "full_outer")
    wrong = F.col("_left").isNull() | F.col("_right").isNull()
    for c in shared:
        wrong = wrong | ~F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return j.where(F.when(wrong, F.raise_error(F.lit("tables to join differ in their keys or shared fields")).cast("boolean")).otherwise(F.lit(True))).drop("_left", "_right", *[f"_r_{c}" for c in shared])


def assemble(common: DataFrame, ladders: list[DataFrame], key: list[str], shared: list[str] | None = None) -> DataFrame:
    """One wide row for each key: the common table and one score table for each rule."""
    out = common
    for one in ladders:
        out = _checked(out, one, key, shared or [])
    return out


def append_scores(rows: DataFrame, auxiliary: DataFrame, key: list[str], names: list[str], shared: list[str]) -> DataFrame:
    """``rows`` with named score columns of another run over the same cohort; shared columns must match exactly."""
    return _checked(rows, auxiliary.select(*key, *shared, *names), key, shared)


def average_repeats(rows: DataFrame, key: list[str], cond: list[str], score: str, risk: str) -> tuple[DataFrame, DataFrame]:
    """For each key the mean and deviation over repeats, and for each condition the range of the repeats' areas."""
    per = rows.groupBy(*key).agg(F.avg(score).alias("mean"), F.stddev_pop(score).alias("sd"), F.max(risk).alias("risk"))
    areas = S.aurc(rows, [*cond, "repeat"], score, risk)
    return per, areas.groupBy(*cond).agg((F.max("aurc") - F.min("aurc")).alias("aurc_range"))


def robustness(variants: DataFrame, primary: DataFrame, cond: list[str], score: str, risk: str) -> DataFrame:
    """Areas of each variant beside the primary run's, and their difference."""
    v = S.summary(variants, [*cond, "variant"], score, risk).select(*cond, "variant", "aurc", "excess")
    p = S.summary(primary, cond, score, risk).select(*cond, F.col("aurc").alias("primary_aurc"))
    return v.join(p, cond).withColumn("change", F.col("aurc") - F.col("primary_aurc"))
