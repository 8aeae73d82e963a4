"""Small helpers shared by the corpus operators: tables, written stages, components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import scratch

#: ASCII white space, as every word rule of this subpackage uses it.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(df: DataFrame) -> DataFrame:
    """``df``, after making sure that Python workers find this package where it runs from a folder.

    On a cluster without that folder the package is given with --py-files, as any other.
    """
    env = df.sparkSession.sparkContext.environment
    root = str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (root, env.get("PYTHONPATH")) if x)
    return df


def trimmed(task: Callable) -> Callable:
    """``task`` of a Python worker, which gives freed memory back to the system before and after it."""

    def run(*tables: pa.Table) -> pa.Table:
        trim()
        out = task(*tables)
        del tables
        trim()
        return out

    # the number of parameters tells Spark what a task of groups wants
    return (lambda table: run(table)) if task.__code__.co_argcount == 1 else (lambda left, right: run(left, right))


def trim() -> None:
    """Freed memory of this process back to the system: idle Python workers and their executor share one limit."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have, in any case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def named(column: str) -> str:
    """A column name as an expression refers to it, whatever characters it has."""
    return "`" + column.replace("`", "``") + "`"


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def row_hash(text: Column) -> Column:
    """What tells rows of one doc_id apart: a hash of the text."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an undirected edge table; root is the smallest node of the component.

    Alternating large-star and small-star rounds. The minimum over a node's neighbours is an aggregate with
    map-side partial sums, and it comes back to the edges by a join that can split a hot key, so a hub with a third
    of all edges is never gathered in one task. Each round is a written table; the loop ends when a round changes
    nothing. Nulls and self loops carry no information and are ignored; an empty table gives an empty table.
    """

    def state(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    now = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v and u > v")
        .distinct()
    )
    now = written(now, "edges")
    before = state(now)
    for _ in range(rounds):
        if not before[0]:
            break
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = (
            both.join(low, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .where("u > v")
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u > v")
            .distinct()
        )
        now = written(small, "edges")
        after = state(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
