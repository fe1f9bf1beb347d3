"""Copies planned and verified by digest, required files, and size ceilings."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteferry.functions.scale import hot_key_lookup
from siteferry.functions.text import first_match

# Gzip ceilings in bytes.
FREE_CEILING = 3_145_728
PAID_CEILING = 10_485_760

# Generated files a deployable site needs (True: a folder with something in it), and how
# each is made.
REQUIRED_ARTIFACTS = (
    ("assets/driver.json", False, "assets:driver"),
    ("assets/prefill.json", False, "lift-prefill"),
    ("assets/core", True, "assets:static"),
    ("assets/modules", True, "assets:static"),
    ("assets/drupal-pf/core.pf.json", False, "assets:twig, assets:core, assets:pack"),
    ("assets/drupal-pf/core.pf.bin", False, "assets:twig, assets:core, assets:pack"),
    ("assets/drupal-sql", True, "assets:sql"),
    ("assets/drupal/twig-bake.json", False, "assets:twig"),
)


def is_safe_relative(path: Column) -> Column:
    """Not empty, not absolute, and no part of it climbs out."""
    return F.coalesce(
        (path != "") & ~F.startswith(path, F.lit("/")) & ~F.array_contains(F.split(path, "/"), ".."), F.lit(False)
    )


def normalise_path(path: Column) -> Column:
    """`a/./b` and `a/b/../c` collapsed; a `..` with nothing before it vanishes."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    kept = F.reduce(
        parts,
        empty,
        lambda out, p: F.when(p == "..", F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))).otherwise(
            F.concat(out, F.array(p))
        ),
    )
    return F.array_join(kept, "/")


def copy_plan(entries: DataFrame, source: DataFrame, target: DataFrame) -> DataFrame:
    """(from, to, verdict, bytes, sha256) for entries (from, to) against two inventories.

    Verdicts are unsafe (the target path leaves the workspace), absent (no such source), create, identical
    and overwrite. One source may be copied to very many places; it is then looked up in
    copies spread over many tasks.
    """
    have = source.select(F.col("path").alias("from"), "bytes", "sha256")
    there = target.select(F.col("path").alias("to"), F.col("sha256").alias("_there"))
    looked = hot_key_lookup(entries.select("from", "to"), have, ["from"], ["to"]).join(there, "to", "left")
    verdict = (
        F.when(~is_safe_relative(F.col("to")), "unsafe")
        .when(F.col("sha256").isNull(), "absent")
        .when(F.col("_there").isNull(), "create")
        .when(F.col("_there") == F.col("sha256"), "identical")
        .otherwise("overwrite")
    )
    return looked.select("from", "to", verdict.alias("verdict"), "bytes", "sha256")


def change_set(plan: DataFrame) -> DataFrame:
    """What applying the plan does: (to, action, backed_up); unsafe and absent entries stop a plan instead."""
    verdict = F.col("verdict")
    action = F.when(verdict == "identical", "unchanged").when(verdict.isin("create", "overwrite"), "written")
    return plan.filter(verdict.isin("identical", "create", "overwrite")).select(
        "to", action.alias("action"), (verdict == "overwrite").alias("backed_up")
    )


def plan_counts(plan: DataFrame) -> DataFrame:
    """One row: entries per verdict, backups needed, and whether the plan may be applied."""
    names = ("unsafe", "absent", "create", "identical", "overwrite")
    counted = plan.agg(*[F.count_if(F.col("verdict") == v).alias(v) for v in names])
    return counted.withColumn("backups", F.col("overwrite")).withColumn(
        "applicable", (F.col("unsafe") == 0) & (F.col("absent") == 0)
    )


def backup_paths(plan: DataFrame, now: dt.datetime, root: str = "") -> DataFrame:
    """(to, backup, copies): where each overwritten file is saved, one flat folder per run.

    `copies` above 1 tells that several files would be saved under one name.
    """
    at = now.astimezone(dt.timezone.utc)
    stamp = at.strftime("%Y%m%dT%H%M%S") + f"{at.microsecond // 1000:03d}Z"
    folder = f"{root.rstrip('/')}/.backup/{stamp}/" if root else f".backup/{stamp}/"
    relative = F.col("to")
    if root:
        prefix = root.rstrip("/") + "/"
        relative = F.when(F.startswith("to", F.lit(prefix)), F.substring("to", F.lit(len(prefix) + 1), F.length("to"))).otherwise(
            F.col("to")
        )
    flat = F.replace(F.regexp_replace(relative, r"^/+", ""), F.lit("/"), F.lit("__"))
    saved = plan.filter(F.col("verdict") == "overwrite").select("to", F.concat(F.lit(folder), flat).alias("backup"))
    clashes = saved.groupBy("backup").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return saved.join(clashes, "backup", "left").fillna(1, ["copies"]).select("to", "backup", "copies")


def verify_backup(manifest: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each manifest entry (set, path, backup, sha256) as ok, missing or mismatch, with the digest found."""
    found = inventory.select(F.col("path").alias("backup"), F.col("sha256").alias("found"))
    state = F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col("sha256"), "mismatch").otherwise("ok")
    return hot_key_lookup(manifest, found, ["backup"], ["set", "path"]).withColumn("state", state)


def backup_gate(verified: DataFrame) -> DataFrame:
    """Per set: entries, problems, and `restorable` only when every entry is ok."""
    counted = verified.groupBy("set").agg(
        F.count(F.lit(1)).alias("entries"), F.count_if(F.col("state") != "ok").alias("problems")
    )
    return counted.withColumn("restorable", F.col("problems") == 0)


def missing_required(
    sites: DataFrame,
    inventory: DataFrame,
    required: Sequence[tuple[str, bool, str]] = REQUIRED_ARTIFACTS,
    by: str = "site",
) -> DataFrame:
    """(site, path, produces): required files a site lacks; a folder counts only with something under it.

    The requirements are a short list, so each inventory row is tested against them in place and a site is
    folded to one flag per requirement before the shuffle.
    """
    path = F.col("path")
    there = [F.startswith(path, F.lit(p + "/")) if folder else path == p for p, folder, _ in required]
    flags = inventory.groupBy(by).agg(*[F.bool_or(t).alias(f"_has_{i}") for i, t in enumerate(there)])
    lacking = F.array(
        *[
            F.when(
                ~F.coalesce(f"_has_{i}", F.lit(False)),
                F.struct(F.lit(p).alias("path"), F.lit(made).alias("produces")),
            )
            for i, (p, _, made) in enumerate(required)
        ]
    )
    full = sites.select(by).distinct().join(flags, by, "left")
    return full.select(by, F.inline(F.filter(lacking, lambda x: x.isNotNull())))


def gzip_bytes(log: Column) -> Column:
    """The gzip size a build log prints, in bytes: KiB first, then MiB, then B; null when it prints none."""
    amount = lambda unit: first_match(log, rf"gzip:\s*([\d.]+)\s*{unit}").try_cast("double")
    plain = first_match(log, r"gzip:\s*(\d+)\s*B(?![0-9A-Za-z_])").try_cast("bigint")
    return F.coalesce(
        F.round(amount("KiB") * 1024).cast("bigint"), F.round(amount("MiB") * 1024 * 1024).cast("bigint"), plain
    )


def ceiling(logs: DataFrame, log: str = "log") -> DataFrame:
    """Replaces the log by bytes, whether they fit each ceiling, and the room left (negative when over).

    A log without a figure gives nulls throughout: not measured is not a fit.
    """
    size = logs.withColumn("bytes", gzip_bytes(F.col(log))).drop(log)
    return size.select(
        "*",
        (F.col("bytes") <= FREE_CEILING).alias("fits_free"),
        (F.col("bytes") <= PAID_CEILING).alias("fits_paid"),
        (F.lit(FREE_CEILING) - F.col("bytes")).alias("free_headroom"),
        (F.lit(PAID_CEILING) - F.col("bytes")).alias("paid_headroom"),
    )
