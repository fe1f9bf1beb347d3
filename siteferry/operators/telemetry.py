"""CPU time per execution model, and whether a capture may be quoted at all."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siteferry.functions import variant as V
from siteferry.functions.scale import BROADCAST_ROWS, keyed_lookup
from siteferry.session import cut_lineage

# The sample count below which no verdict is given, and the spread that is reported.
MIN_SAMPLES = 3
WIDE_SPREAD_MS = 400

STATELESS = "stateless"
DURABLE = "durableObject"


def normalise_events(records: DataFrame, value: str = "value") -> DataFrame:
    """One typed row per JSON object in the VARIANT column `value`; other JSON values are dropped.

    A model of the wrong type becomes `unknown`; a number or text of the wrong type becomes null.
    """
    v = F.col(value)
    kept = [c for c in records.columns if c != value]
    return records.filter(V.is_object(v)).select(
        *kept,
        F.coalesce(V.string_at(v, "$.executionModel"), F.lit("unknown")).alias("execution_model"),
        V.number_at(v, "$.cpuTime").alias("cpu_time"),
        V.number_at(v, "$.wallTime").alias("wall_time"),
        V.string_at(v, "$.outcome").alias("outcome"),
        V.string_at(v, "$.scriptName").alias("script_name"),
    )


def cpu_summary(
    events: DataFrame,
    by: Sequence[str] = ("capture",),
    accuracy: int = 10_000,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """n, exact median, min, max and spread of `cpu_time` per group and model; null times excluded.

    The median is selected without bringing a group into one task. A first pass takes count, min, max
    and a quantile sketch, all combined before the shuffle. The sketch brackets the median to a
    thousandth of the group; a second pass counts what lies below the bracket and ranks only the
    distinct values inside it.
    """
    keys = [*by, "execution_model"]
    timed = events.filter(F.col("cpu_time").isNotNull()).select(*keys, "cpu_time")
    margin = 5 / accuracy
    stats = timed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("cpu_time").alias("min"),
        F.max("cpu_time").alias("max"),
        F.percentile_approx("cpu_time", [0.5 - margin, 0.5 + margin], accuracy).alias("_span"),
    )
    bounds = cut_lineage(stats)
    if bounds.count() <= broadcast_rows:
        placed = timed.withColumn("_rows", F.lit(1)).join(F.broadcast(bounds), keys)
    else:
        distinct = timed.groupBy(*keys, "cpu_time").agg(F.count(F.lit(1)).alias("_rows"))
        placed = keyed_lookup(distinct, bounds, keys, ["cpu_time"], how="inner")
    below = F.col("cpu_time") < F.col("_span")[0]
    counted = (
        placed.filter(F.col("cpu_time") <= F.col("_span")[1])
        .groupBy(*keys, "n", "min", "max", below.alias("_below"), F.when(~below, F.col("cpu_time")).alias("_value"))
        .agg(F.sum("_rows").alias("_rows"))
    )
    ordered = Window.partitionBy(*keys).orderBy(F.desc("_below"), "_value")
    running = F.sum("_rows").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counted.withColumn("_upto", running)
    lower = F.floor((F.col("n") + 1) / 2)
    upper = F.floor(F.col("n") / 2) + 1
    picked = ranked.groupBy(*keys, "n", "min", "max").agg(
        F.min(F.when(F.col("_upto") >= lower, F.col("_value"))).alias("_low"),
        F.min(F.when(F.col("_upto") >= upper, F.col("_value"))).alias("_high"),
        F.coalesce(F.sum(F.when(F.col("_below"), F.col("_rows"))), F.lit(0)).alias("_under"),
    )
    missed = (F.col("_under") >= lower) | F.col("_high").isNull()
    median = F.when(missed, F.raise_error(F.lit("the bracket missed the median")).cast("double")).otherwise(
        (F.col("_low") + F.col("_high")) / 2
    )
    return picked.select(
        *keys, "n", median.alias("median"), "min", "max", (F.col("max") - F.col("min")).alias("spread")
    )


def capture_verdict(
    events: DataFrame, captures: DataFrame | None = None, by: Sequence[str] = ("capture",)
) -> DataFrame:
    """Per capture: events, samples of the two known models, `instrument_failure` and `usable`.

    `captures` lists every capture read, so one without a single event still gets its row.
    """
    by = list(by)
    timed = F.col("cpu_time").isNotNull()
    counted = events.groupBy(*by).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(timed & (F.col("execution_model") == STATELESS)).alias("stateless_n"),
        F.count_if(timed & (F.col("execution_model") == DURABLE)).alias("durable_n"),
    )
    if captures is not None:
        counted = captures.select(*by).distinct().join(counted, by, "left").fillna(
            0, ["events", "stateless_n", "durable_n"]
        )
    failed = (F.col("stateless_n") > 0) & (F.col("durable_n") == 0)
    return counted.select(
        "*",
        failed.alias("instrument_failure"),
        (~failed & (F.col("stateless_n") + F.col("durable_n") > 0)).alias("usable"),
    )


def cpu_notes(
    events: DataFrame, captures: DataFrame | None = None, by: Sequence[str] = ("capture",)
) -> DataFrame:
    """What a reader of the figures must know, one row per note, ordered by `note_rank` and model."""
    by = list(by)
    verdict = capture_verdict(events, captures, by)
    of_capture = F.array(
        _note(
            F.col("instrument_failure"),
            1,
            "instrument-failure",
            F.lit("stateless events but no durableObject event: the capture lost the expensive half, quote nothing"),
        ),
        _note(
            (F.col("durable_n") > 0) & (F.col("durable_n") < MIN_SAMPLES),
            2,
            "few-samples",
            F.concat(F.lit("n="), F.col("durable_n"), F.lit(" durableObject events: too few for an absolute figure")),
        ),
        _note(
            F.col("events") == 0,
            4,
            "empty-capture",
            F.lit("the capture is empty, which is evidence of nothing"),
        ),
    )
    general = verdict.select(*by, F.inline(F.filter(of_capture, lambda n: n.isNotNull()))).withColumn(
        "execution_model", F.lit(None).cast("string")
    )
    spread = (
        events.filter(F.col("cpu_time").isNotNull())
        .groupBy(*by, "execution_model")
        .agg((F.max("cpu_time") - F.min("cpu_time")).alias("spread"))
        .filter(F.col("spread") > WIDE_SPREAD_MS)
    )
    shown = F.when(
        F.col("spread") == F.floor("spread"), F.col("spread").cast("bigint").cast("string")
    ).otherwise(F.col("spread").cast("string"))
    wide = spread.select(
        *by,
        F.lit(3).alias("note_rank"),
        F.lit("wide-spread").alias("note_id"),
        F.concat(
            F.col("execution_model"), F.lit(" spans "), shown, F.lit(" ms: quote the spread with the median")
        ).alias("note"),
        "execution_model",
    )
    return general.unionByName(wide)


def _note(condition: Column, rank: int, note_id: str, text: Column) -> Column:
    return F.when(
        condition,
        F.struct(F.lit(rank).alias("note_rank"), F.lit(note_id).alias("note_id"), text.alias("note")),
    )
