"""Check results rolled up to a verdict per subject; a check that could not run is never a pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The checks in report order, and what each gate insists on.
ALL_CHECKS = ("workspace", "artifacts", "config", "scrub", "bundle")
GATES = {
    "dev": ("workspace", "artifacts", "config"),
    "deploy": ("workspace", "artifacts", "config", "scrub", "bundle"),
}


def wanted_checks(only: str | Sequence[str] | None) -> tuple[str, ...]:
    """The checks asked for, in report order: a gate name, a comma list, a list, or all of them."""
    if only is None:
        return ALL_CHECKS
    names = GATES.get(only, only.split(",")) if isinstance(only, str) else only
    names = {n.strip() for n in names} - {""}
    unknown = sorted(names - set(ALL_CHECKS))
    if unknown:
        raise ValueError(f"unknown check(s) {', '.join(unknown)}; expected {', '.join(ALL_CHECKS)}")
    return tuple(c for c in ALL_CHECKS if c in names)


def gate(
    checks: DataFrame,
    subjects: DataFrame | None = None,
    only: str | Sequence[str] | None = None,
    subject: str = "subject",
) -> DataFrame:
    """Per subject: failed ids (ran and not ok), skipped ids (not run, or no row at all), and ok.

    One flag pair per check, combined before the shuffle; no list of rows is ever collected.
    """
    wanted = wanted_checks(only)
    ran = F.coalesce("ran", F.lit(False))
    bad = ran & ~F.coalesce("ok", F.lit(False))
    flags = []
    for check in wanted:
        mine = F.col("id") == check
        flags.append(F.coalesce(F.bool_or(mine & bad), F.lit(False)).alias(f"_bad_{check}"))
        flags.append(F.coalesce(F.bool_or(mine & ran), F.lit(False)).alias(f"_ran_{check}"))
    rolled = checks.filter(F.col("id").isin(*wanted)).groupBy(subject).agg(*flags)
    dimension = (checks if subjects is None else subjects).select(subject).distinct()
    full = dimension.join(rolled, subject, "left")
    is_bad = {c: F.coalesce(f"_bad_{c}", F.lit(False)) for c in wanted}
    has_run = {c: F.coalesce(f"_ran_{c}", F.lit(False)) for c in wanted}
    listed = lambda flags: F.filter(
        F.array(*[F.when(flag, F.lit(c)) for c, flag in flags.items()]), lambda x: x.isNotNull()
    )
    report = full.select(
        subject,
        listed(is_bad).alias("failed"),
        listed({c: ~flag for c, flag in has_run.items()}).alias("skipped"),
    )
    return report.withColumn("ok", F.size("failed") == 0)


def gate_verdict(report: DataFrame) -> DataFrame:
    """Adds `verdict`: validation, else validation-incomplete, else ready."""
    return report.withColumn(
        "verdict",
        F.when(F.size("failed") > 0, "validation")
        .when(F.size("skipped") > 0, "validation-incomplete")
        .otherwise("ready"),
    )


def check_result(checks: DataFrame) -> DataFrame:
    """Adds `result`: `not run`, `ok` or `FAIL`."""
    return checks.withColumn(
        "result", F.when(~F.col("ran"), "not run").when(F.col("ok"), "ok").otherwise("FAIL")
    )
