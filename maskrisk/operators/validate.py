"""Contracts of tables: each check gives its violations as a table, and a strict form fails the query itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scores import count_if


def check_maps(px: DataFrame, key: list[str], strict: bool = False) -> DataFrame:
    """Images whose pixels are no full rectangle of finite probabilities in [0, 1] and truths of 0 or 1."""
    p = F.col("p")
    per = px.groupBy(*key).agg(
        count_if(p.isNull() | F.isnan("p")).alias("missing"), count_if((p < 0) | (p > 1)).alias("outside"), count_if(F.col("truth").isNull() | ~F.col("truth").isin(0, 1)).alias("bad_truth"),
        ((F.max("y") + 1) * (F.max("x") + 1) - F.count_distinct(F.struct("y", "x"))).cast("long").alias("gaps"), (F.count("*") - F.count_distinct(F.struct("y", "x"))).cast("long").alias("repeated"),
    )
    bad = per.where("missing + outside + bad_truth + gaps + repeated > 0")
    return bad.withColumn("gaps", F.raise_error(F.concat(F.lit("bad map "), *[F.col(k).cast("string") for k in key])).cast("long")) if strict else bad


def check_records(rows: DataFrame, cond: list[str], key: str, unit: list[str]) -> DataFrame:
    """For each condition: repeated keys, missing or non-finite numbers, numbers outside [0, 1]."""
    bad = [count_if(F.col(c).isNull() | F.isnan(c)) for c in unit]
    out = [count_if((F.col(c) < 0) | (F.col(c) > 1)) for c in unit]
    return rows.groupBy(*cond).agg((F.count("*") - F.count_distinct(key)).alias("repeated"), sum(bad[1:], bad[0]).alias("missing"), sum(out[1:], out[0]).alias("outside"))


def differences(left: DataFrame, right: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Rows that only one side has, and fields that are not equal: one row each with what is wrong."""
    j = left.select(*key, *[F.col(c).alias(f"l_{c}") for c in fields], F.lit(1).alias("_l")).join(right.select(*key, *[F.col(c).alias(f"r_{c}") for c in fields], F.lit(1).alias("_r")), key, "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    wrong = [F.when(both & ~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.lit(c)) for c in fields]
    side = F.when(F.col("_l").isNull(), "only right").when(F.col("_r").isNull(), "only left")
    return j.select(*key, F.explode(F.array_compact(F.array(side, *wrong))).alias("wrong"))


def tolerant_differences(left: DataFrame, right: DataFrame, key: list[str], fields: list[str], rel: float = 2e-12, abs_: float = 2e-12) -> DataFrame:
    """Rows that only one side has, and numbers further apart than the relative and absolute tolerance allow."""
    j = left.select(*key, *[F.col(c).alias(f"l_{c}") for c in fields], F.lit(1).alias("_l")).join(right.select(*key, *[F.col(c).alias(f"r_{c}") for c in fields], F.lit(1).alias("_r")), key, "full_outer")
    both = F.col("_l").isNotNull() & F.col("_r").isNotNull()

    def apart(c):
        a, b = F.col(f"l_{c}"), F.col(f"r_{c}")
        close = F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(abs_))
        return F.when(both & ~F.coalesce(close, a.isNull() & b.isNull()), F.lit(c))

    side = F.when(F.col("_l").isNull(), "only right").when(F.col("_r").isNull(), "only left")
    return j.select(*key, F.explode(F.array_compact(F.array(side, *[apart(c) for c in fields]))).alias("wrong"))


def complete_conditions(rows: DataFrame, expected: DataFrame, cond: list[str], share: float = 0.95) -> DataFrame:
    """Each expected condition with its rows and whether it has at least ``share`` of those expected."""
    n = rows.groupBy(*cond).agg(F.count("*").alias("n"))
    return expected.join(n, cond, "left").select(*cond, "expected", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) >= share * F.col("expected")).cast("int").alias("kept"))


def condition_matrix(got: DataFrame, declared: DataFrame, cond: list[str]) -> DataFrame:
    """Conditions that are missing, not declared, or listed twice."""
    one = lambda df, what: df.select(*cond, F.lit(what).alias("wrong"))
    twice = got.groupBy(*cond).count().where("count > 1")
    return one(declared.join(got, cond, "left_anti"), "missing").unionByName(one(got.join(declared, cond, "left_anti").distinct(), "undeclared")).unionByName(one(twice, "repeated"))


def check_rules(nodes: DataFrame, rule: str) -> DataFrame:
    """Threshold rules whose nodes do not rise within (0, 1) or whose weights are negative or do not sum to 1."""
    from pyspark.sql import Window as W

    before = F.lag("t").over(W.partitionBy(rule).orderBy("k"))
    n = nodes.withColumn("_flat", F.coalesce(F.col("t") <= before, F.lit(False)))
    c = n.groupBy(rule).agg(count_if(F.col("_flat")).alias("not_rising"), count_if((F.col("t") <= 0) | (F.col("t") >= 1)).alias("outside"), count_if(F.col("w") < 0).alias("negative"), (F.abs(F.sum("w") - 1) > 1e-9).cast("int").alias("bad_sum"))
    return c.where("not_rising + outside + negative + bad_sum > 0")


def bind_to_cohort(manifests: DataFrame, locked: DataFrame, cond: list[str], fields: list[str]) -> DataFrame:
    """Each manifest against the locked row of its condition: which fields differ, or that no lock exists."""
    return differences(manifests, locked, cond, fields)
