"""Pixel, record and stream tables derived from the star-schema and corpus tables, for queries, tests and benches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

KEY = ["dataset", "condition", "sample_id"]
COND = ["dataset", "condition"]
#: Lines that a task orders by supplier, about.
LINES = 1 << 18


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str, spread: bool = False) -> DataFrame:
    """8 x 8 probability maps of ``embeddings``; a pixel's truth is its label's majority.

    ``spread`` deals the maps to tasks before pixels arise, as a file of few row groups is read by few tasks.
    """
    maps = read(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    e = (maps.repartition("vec_id") if spread else maps).select("vec_id", "label", F.posexplode("embedding").alias("i", "e"))
    q = e.select("vec_id", "label", "i", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 + 2 * F.col("e").cast("double"))).alias("p"))
    on = F.sum(F.when(F.col("p") >= 0.5, 1).otherwise(0))
    t = q.groupBy("label", "i").agg((2 * on >= F.count("*")).cast("int").alias("truth"))
    return q.join(t, ["label", "i"]).select(
        F.lit("emb").alias("dataset"), F.col("label").cast("string").alias("condition"), F.col("vec_id").alias("sample_id"),
        F.expr("i div 8").cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), "p", "truth",
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score record for each order, of integer sums over its lines, so that ties are exact."""
    cents = lambda c: F.sum(F.round(100 * F.col(c)).cast("long"))
    a = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), cents("l_discount").alias("d"), cents("l_tax").alias("t"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    d, t, q, n = (F.col(c).cast("double") for c in "dtqn")
    return read(spark, sf_dir, "orders").join(a, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.col("o_orderpriority").alias("dataset"), F.col("o_orderstatus").alias("condition"), F.col("o_orderkey").alias("sample_id"), F.col("o_custkey").alias("cluster_id"),
        (F.col("o_orderkey") % 3).cast("int").alias("seed"), (d / (10 * n)).alias("risk_dice"), (t / (8 * n)).alias("risk_nhd"),
        (-(5 * d + q) / (100 * n)).alias("confidence_dice_m32"), (-(5 * t + q) / (90 * n)).alias("confidence_nhd_m32"), (1 - (d + t) / (18 * n)).alias("confidence_sdc"),
    )


def large_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noisy discs of 24 columns, one for each supplier, with a pixel for each of its order lines."""
    li = read(spark, sf_dir, "lineitem")
    parts = -(-li.count() // LINES)  # the rows of a task do not grow with the table
    if parts > int(spark.conf.get("spark.sql.shuffle.partitions")):
        li = li.repartition(parts, "l_suppkey")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus"]
    r = li.withColumn("r", F.row_number().over(W.partitionBy("l_suppkey").orderBy(*order)) - 1)
    k = r.select(F.col("l_suppkey").alias("s"), F.expr("CAST(r div 24 AS INT)").alias("y"), F.expr("CAST(r % 24 AS INT)").alias("x"), F.round(100 * F.col("l_discount")).cast("int").alias("d"), F.round(100 * F.col("l_tax")).cast("int").alias("t"))
    g = k.selectExpr("s", "y", "x", "d", "t", "(y-10-s%3)*(y-10-s%3) + (x-11-s%4)*(x-11-s%4) AS d2", "25+s%40 AS r2")
    return g.selectExpr("'disc' AS dataset", "CAST(s % 5 AS STRING) AS condition", "s AS sample_id", "y", "x", "CAST(r2 AS DOUBLE)/(r2+d2+d) AS p", "CASE WHEN d2+t <= r2 THEN 1 ELSE 0 END AS truth")


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three ensemble members for each map of ``pixels``."""
    px = pixels(spark, sf_dir, spread=True).withColumn("member", F.explode(F.array(*[F.lit(j) for j in range(3)])))
    return px.withColumn("p", F.expr("least(1.0D, greatest(0.0D, p + (((7*y + 3*x + 5*member) % 11) - 5) / 100.0D))"))


def stream_rows(df: DataFrame) -> DataFrame:
    """Labelled predictions over time from rows of ``events``, batch or streaming."""
    return df.selectExpr("CAST(ts AS TIMESTAMP) AS ts", "user_id", "value/(value+50) AS p", "CASE WHEN event_type='error' THEN 1 ELSE 0 END AS truth", "event_type", "value")


def documents_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary-risk records in small groups, many of them of constant risk."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(read(spark, sf_dir, "labels"), "doc_id")
    return d.select(F.col("lang").alias("dataset"), F.col("doc_id").alias("sample_id"), F.col("source").alias("condition"), (1 - F.col("quality")).cast("double").alias("risk"), F.col("toxic").cast("double").alias("risk2"), F.col("n_chars").cast("double").alias("confidence"))
