"""Images that a task can hold, one behind the other; the rows that a task gets do not grow with the table.

Pixels are dealt by image to as many tasks as their number asks for and sorted there; a task reads them as a stream and
works on pieces of it that end between two images. Images above ``WHOLE`` are not dealt so: operators take them by their
rows and columns, which are spread over tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.shared import shipped

#: Most pixels, and cells of its frame, of an image that a task holds; pixels of a piece and of a task, about.
WHOLE, PIECE, SHARE = 1 << 14, 1 << 16, 1 << 18


def shares(px: DataFrame, share: int = SHARE) -> int:
    """Tasks for a written table, so that each gets about ``share`` rows."""
    return max(px.sparkSession.sparkContext.defaultParallelism, -(-px.count() // share))


def by_size(px: DataFrame, key: list[str], whole: int = WHOLE) -> tuple[DataFrame, DataFrame | None]:
    """The images of a written table that a task can hold, and the others if there are any."""
    size = px.groupBy(*key).agg(F.count("*").alias("n"), F.max("y").cast("long").alias("h"), F.max("x").cast("long").alias("w"), F.min(F.least("y", "x")).alias("low"))
    large = size.where((F.col("n") > whole) | ((F.col("h") + 1) * (F.col("w") + 1) > whole) | (F.col("low") < 0)).select(*key)
    if large.isEmpty():
        return px, None
    return px.join(large, key, "left_anti"), px.join(large, key, "left_semi")


def changes(column: pa.Array) -> np.ndarray:
    """For each value whether it differs from the one before; nulls are equal, and the first value is a change."""
    a, b = column.slice(0, len(column) - 1), column.slice(1)
    differs = pc.if_else(pc.or_(a.is_null(), b.is_null()), pc.xor(a.is_null(), b.is_null()), pc.not_equal(a, b))
    return np.concatenate([[True], differs.to_numpy(zero_copy_only=False).astype(bool)])


def per_image(px: DataFrame, key: list[str], parts: int, work: Callable[[pa.Table, np.ndarray], pa.Table], schema: T.StructType) -> DataFrame:
    """``work`` over pieces of ``px``: whole images in order of y and x, and the row where each image begins."""
    dealt = shipped(px).withColumn("_image", F.xxhash64(*key)).repartition(parts, *key).sortWithinPartitions("_image", *key, "y", "x")

    def begins(piece: pa.Table) -> np.ndarray:
        return np.flatnonzero(np.logical_or.reduce([changes(piece.column(k)) for k in ("_image", *key)]))

    def out(piece: pa.Table, first: np.ndarray) -> Iterator[pa.RecordBatch]:
        yield from work(piece, first).select(schema.names).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < PIECE:
                continue
            piece = pa.Table.from_batches(held).combine_chunks()
            first = begins(piece)
            if len(first) > 1:
                yield from out(piece.slice(0, first[-1]).combine_chunks(), first[:-1])
            held = piece.slice(first[-1]).to_batches()
            rows = sum(b.num_rows for b in held)
        if rows:
            piece = pa.Table.from_batches(held).combine_chunks()
            yield from out(piece, begins(piece))

    return dealt.mapInArrow(run, schema)
