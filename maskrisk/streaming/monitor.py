"""A calibration monitor that stays up to date as labelled predictions arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.shared import scratch
from ..operators.calibration import accumulators, from_accumulators


def windowed(rows: DataFrame, width: str = "1 day", bins: int = 15) -> DataFrame:
    """Calibration sums for each time window and bin; the same query over a stream and over a table."""
    acc = accumulators(rows, [F.window("ts", width).alias("w")], bins)
    return acc.select(F.col("w.start").alias("start"), "bin", "n", "sum_p", "sum_truth", "sum_sq")


def monitor(stream: DataFrame, late: str = "2 days", width: str = "1 day", bins: int = 15) -> DataFrame:
    """``windowed`` over a stream with a watermark: rows later than it are dropped, closed windows are appended."""
    return windowed(stream.withWatermark("ts", late), width, bins)


def run_once(spark: SparkSession, rows: DataFrame, path: str, late: str = "2 days", checkpoint: str | None = None) -> DataFrame:
    """Run the monitor over what the stream has now; closed windows are appended to Parquet files at ``path``, and read."""
    closed = monitor(rows, late)
    q = closed.writeStream.outputMode("append").format("parquet").option("path", path)
    q.option("checkpointLocation", checkpoint or scratch(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(closed.schema).parquet(path)


def report(acc: DataFrame) -> DataFrame:
    """Brier score and calibration error of each window."""
    return from_accumulators(acc, ["start"])
