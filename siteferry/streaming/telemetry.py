"""CPU time per execution model over a stream of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cpu_summary_stream(
    events: DataFrame,
    window: str = "5 minutes",
    watermark: str = "10 minutes",
    by: Sequence[str] = ("capture",),
    at: str = "ts",
    accuracy: int | None = None,
) -> DataFrame:
    """The measures of the batch summary per event-time window; events later than the watermark are dropped.

    The exact median keeps the distinct times of a window and model as state, and windows bound it. Where
    one model has very many distinct times in a window, `accuracy` takes a sketch of fixed size instead.
    """
    timed = events.filter(F.col("cpu_time").isNotNull()).withColumn(at, F.col(at).cast("timestamp"))
    if accuracy is None:
        median = F.percentile("cpu_time", 0.5)
    else:
        median = F.percentile_approx("cpu_time", 0.5, accuracy)
    grouped = timed.withWatermark(at, watermark).groupBy(F.window(at, window).alias("_w"), *by, "execution_model")
    return grouped.agg(
        F.count(F.lit(1)).alias("n"),
        median.alias("median"),
        F.min("cpu_time").alias("min"),
        F.max("cpu_time").alias("max"),
    ).select(
        F.col("_w.start").alias("window_start"),
        *by,
        "execution_model",
        "n",
        "median",
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("spread"),
    )
