"""The latest earlier value of a log, carried forward to each row: an as-of join in one sorted pass."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteferry.functions.scale import broadcast_if_small
from siteferry.session import cut_lineage

MICROS = {"hour": 3_600_000_000, "day": 86_400_000_000}


def carry_last(
    rows: DataFrame, keys: Sequence[str], time: Column, order: Sequence[str], values: Sequence[str], every: str = "hour"
) -> DataFrame:
    """Adds `last_<v>` for each of `values`: its latest non-null value among rows of the same keys up to this one.

    Rows are sorted by `order` within stretches of time (`every` hour or day), so a key with very many rows is many
    tasks' work; the last values of each stretch, one small row, are carried on to those after it. `order` must begin
    with the time that the stretches are cut by and puts a value before the rows that are to see it. Null keys are a key
    like others; rows of no time come first.
    """
    names = [f"last_{v}" for v in values]
    cut = rows.withColumn("_stretch", F.coalesce(F.floor(F.unix_micros(time.cast("timestamp")) / MICROS[every]), F.lit(-(2**62))).cast("bigint"))
    sorted_ = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = cut_lineage(cut.select("*", *[F.last(v, ignorenulls=True).over(sorted_).alias(n) for v, n in zip(values, names)]))
    # the latest value of a stretch stands in its last row
    place = F.struct(*order)
    ends = within.groupBy(*keys, "_stretch").agg(*[F.max_by(n, place).alias(n) for n in names])
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *[F.col(k).alias(f"_{k}") for k in keys], F.col("_stretch").alias("_at"),
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"_{n}") for n in names],
    )
    any_known = reduce(or_, [F.col(f"_{n}").isNotNull() for n in names])
    known = broadcast_if_small(carried.filter(any_known))
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], F.col("_stretch") == F.col("_at"))
    joined = within.join(known, same, "left")
    return joined.select(*rows.columns, *[F.coalesce(n, f"_{n}").alias(n) for n in names])
