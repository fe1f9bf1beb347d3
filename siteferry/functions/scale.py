"""Joins that hold when one key carries a large part of all rows, and size-checked broadcasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteferry.session import cut_lineage

# A broadcast side must have at most this many rows (of a few small columns each).
BROADCAST_ROWS = 200_000

DEFAULT_SALTS = 16


def keyed_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    salts: int = DEFAULT_SALTS,
    how: str = "left",
) -> DataFrame:
    """Joins facts to a lookup holding one row per key, spreading each key over `salts` tasks.

    The salt is a hash of fact columns, so a task that is run again after an executor is lost puts
    every row in the same place. The lookup grows by the factor `salts`, so it should be a list of
    accounts, hosts or groups, not of rows; `hot_key_lookup` is for the latter. Its keys are unique, so no
    key becomes heavy on that side. Null keys find nothing and are spread like any other key.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int")
    copies = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return facts.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


def hot_key_lookup(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str],
    spread_by: Sequence[str],
    hot_rows: int = 1_000_000,
    salts: int = 64,
) -> DataFrame:
    """A left join to a lookup too large to be copied `salts` times: only the keys found hot are.

    Facts are first counted per key, combined before the shuffle. At most one key in `hot_rows` rows can be
    hot, which bounds the list of them.
    """
    on = list(on)
    counted = facts.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    hot = broadcast_if_small(counted.select(*on, F.lit(True).alias("_hot")))
    if hot.isEmpty():
        return facts.join(lookup, on, "left")
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int")
    salted = facts.join(hot, on, "left").withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(0)).drop("_hot")
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    copied = lookup.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(copied, [*on, "_salt"], "left").drop("_salt")


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast only after counting; a larger frame is returned without the hint.

    The frame is written to the shared folder first, so counting it does not compute it twice.
    """
    kept = cut_lineage(df)
    return F.broadcast(kept) if kept.count() <= max_rows else kept


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns through a one-row generator, so later filters and columns reuse their values.

    The optimizer otherwise copies an expression into every place that names it, which for long regular
    expression chains costs far more than this extra step.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def fill_cores(df: DataFrame) -> DataFrame:
    """Spreads a scan that has fewer splits than the cluster has cores, for work heavy on each row.

    A scan with enough splits, which is every scan of a large table, is left as it is.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
