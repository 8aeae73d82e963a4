"""Exact places, running sums and order statistics within conditions that no task has to hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.shared import written


def places(rows: DataFrame, cond: list[str], by: list[str | Column], name: str = "place", count: str = "of", sums: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``name``, the place from 1 in the order ``by`` within the condition, and ``count``, its number of rows.

    Rows are dealt to ranges of (condition, by), so a condition of most rows lies over many tasks; each range numbers its
    own, and the rows of a condition in the ranges before are added. Rows that agree in all of ``by`` share a range and
    are numbered in any order; nulls come first. The dealt rows are written once, so that no range can change. ``sums``
    names columns and the sums of them up to each row that are added; nulls count as 0.
    """
    sums = sums or {}
    keys = [F.col(b) if isinstance(b, str) else b for b in by]
    keyed = rows.withColumns({f"_k{i}": k for i, k in enumerate(keys)})
    order = [f"_k{i}" for i in range(len(keys))]
    dealt = written(keyed.repartitionByRange(*cond, *order).withColumn("_range", F.spark_partition_id()), "places")
    sizes = dealt.groupBy(*cond, "_range").agg(F.count("*").alias("_n"), *[F.sum(c).alias(f"_t_{c}") for c in sums])
    w = W.partitionBy(*cond)  # a row for each range
    past = w.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    earlier = [F.coalesce(F.sum(f"_t_{c}").over(past), F.lit(0)).alias(f"_b_{c}") for c in sums]
    sizes = sizes.select(*cond, "_range", F.coalesce(F.sum("_n").over(past), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias(count), *earlier)
    inner = W.partitionBy(*cond, "_range").orderBy(*order)
    upto = inner.rowsBetween(W.unboundedPreceding, 0)
    own = dealt.withColumns({name: F.row_number().over(inner), **{s: F.coalesce(F.sum(c).over(upto), F.lit(0)) for c, s in sums.items()}})
    both = own.join(sizes, [*cond, "_range"]).withColumns({name: F.col(name) + F.col("_before"), **{s: F.col(s) + F.col(f"_b_{c}") for c, s in sums.items()}})
    return both.drop("_range", "_before", *[f"_b_{c}" for c in sums], *order)


def equal_bins(rows: DataFrame, cond: list[str], by: list[str | Column], bins: int, name: str = "bin") -> DataFrame:
    """``rows`` with ``name``: bins from 1 of equal count in the order ``by``; the first ones take one row more, as ntile."""
    placed = places(rows, cond, by, "_place", "_of")
    base, more = F.floor(F.col("_of") / bins), F.col("_of") % bins
    first = more * (base + 1)  # rows in the larger bins
    at = F.col("_place") - 1
    number = F.when(at < first, F.floor(at / (base + 1))).otherwise(more + F.floor((at - first) / F.greatest(base, F.lit(1))))
    return placed.withColumn(name, (number + 1).cast("int")).drop("_place", "_of")


def quantiles(rows: DataFrame, cond: list[str], value: Column, wanted: dict[str, float], stretches: int = 64) -> DataFrame:
    """Exact quantiles of ``value`` for each condition, interpolated as ``percentile`` does: cond, and a column for each of ``wanted``.

    Rows are collapsed to distinct values with counts. Each condition is cut at approximate quantiles into stretches, the
    counts of the stretches say which of them hold a wanted place, and only these are sorted: a task holds no condition.
    Null values are left out, and a condition of nulls alone gives nulls; NaN is the largest value; conditions must not
    be null; an empty table gives no rows.
    """
    v = rows.select(*cond, value.cast("double").alias("_v")).groupBy(*cond, "_v").agg(F.count("*").alias("_n"))
    finite = F.when(~F.isnan("_v"), F.col("_v"))
    cuts = v.groupBy(*cond).agg(F.percentile_approx(finite, [k / stretches for k in range(1, stretches)], 16 * stretches).alias("_cuts"))
    above = F.coalesce(F.size(F.filter("_cuts", lambda e: e < F.col("_v"))), F.lit(0))
    cut = written(v.join(cuts, cond).select(*cond, "_v", "_n", F.when(F.isnan("_v"), F.lit(stretches)).otherwise(above).alias("_stretch")), "values")
    known = cut.where("_v is not null")
    w = W.partitionBy(*cond)  # a row for each stretch
    total = known.groupBy(*cond, "_stretch").agg(F.sum("_n").alias("_t"))
    total = total.select(*cond, "_stretch", "_t", F.coalesce(F.sum("_t").over(w.orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_t").over(w).alias("_of"))

    def spot(q: float) -> tuple[Column, Column, Column]:
        at = (F.col("_of") - 1) * F.lit(float(q))
        return at, F.floor(at), F.ceil(at)

    def within(first: Column, n: Column, place: Column) -> Column:
        return (first <= place) & (place < first + n)

    ends = {q: spot(q)[1:] for q in wanted.values()}
    holds = F.lit(False)
    for low, high in ends.values():
        holds = holds | within(F.col("_before"), F.col("_t"), low) | within(F.col("_before"), F.col("_t"), high)
    some = known.join(total.where(holds).drop("_t"), [*cond, "_stretch"])
    past = W.partitionBy(*cond, "_stretch").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    some = some.withColumn("_first", F.col("_before") + F.coalesce(F.sum("_n").over(past), F.lit(0)))
    found = [F.max(F.when(within(F.col("_first"), F.col("_n"), place), F.col("_v"))).alias(f"_{i}_{side}") for i, q in enumerate(wanted.values()) for side, place in enumerate(ends[q])]
    got = some.groupBy(*cond, "_of").agg(*found)

    def between(i: int, q: float) -> Column:
        (at, low, high), a, b = spot(q), F.col(f"_{i}_0"), F.col(f"_{i}_1")
        return F.when((low == high) | (a == b), a).otherwise((high - at) * a + (at - low) * b)

    got = got.select(*cond, *[between(i, q).alias(name) for i, (name, q) in enumerate(wanted.items())])
    return cut.select(*cond).distinct().join(got, cond, "left")
