"""Command transcripts folded to one survey per host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteferry.functions import variant as V
from siteferry.functions.scale import computed_once
from siteferry.functions.text import first_match, js_trim

# The steps in order, and whether a failure of one is reported.
STEPS = (
    ("php-version", True),
    ("php-modules", True),
    ("drush-version", False),
    ("drush-status", True),
    ("modules", True),
    ("files-kb", False),
    ("files-count", False),
    ("db-bytes", False),
    ("nodes", False),
    ("image-styles", False),
)


def php_version(stdout: Column) -> Column:
    return first_match(stdout, r"(?m)^PHP\s+(\d+\.\d+\.\d+\S*)")


def php_modules(stdout: Column) -> Column:
    """The names under `[PHP Modules]`; any other bracketed line ends the section."""
    trimmed = F.transform(F.split(stdout, "\n", -1), js_trim)
    text = F.concat(F.array_join(trimmed, "\n"), F.lit("\n"))
    sections = F.regexp_extract_all(text, F.lit(r"(?im)^\[php modules\]\n((?:(?!\[.*\]$).*\n)*+)"), 1)
    return F.filter(F.split(F.array_join(sections, "\n"), "\n", -1), lambda line: line != "")


def module_list(stdout: Column) -> Column:
    """Names from a JSON object's keys or an array of texts, sorted; anything else gives no names."""
    v = V.parse_strict(stdout)
    texts = F.transform(
        F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING"),
        lambda x: F.try_variant_get(x, "$", "string"),
    )
    keys = F.when(V.is_object(v), F.json_object_keys(stdout))
    return F.array_sort(F.coalesce(F.when(V.is_array(v), texts), keys, F.array().cast("array<string>")))


def last_count(stdout: Column) -> Column:
    """The leading whole number of the last line that starts with one."""
    lines = F.filter(
        F.transform(F.split(stdout, "\n", -1), lambda line: F.regexp_extract(js_trim(line), r"^(\d+)(?:\s|\z)", 1)),
        lambda n: n != "",
    )
    return F.try_element_at(lines, F.lit(-1)).try_cast("bigint")


def du_kilobytes(stdout: Column) -> Column:
    return first_match(js_trim(stdout), r"(?m)^(\d+)\s").try_cast("bigint")


def _status(v: Column, *names: str) -> Column:
    """The first of the members that is a non-empty text."""
    return F.coalesce(*[F.nullif(V.string_at(v, f"$['{n}']"), F.lit("")) for n in names])


def parse_steps(transcripts: DataFrame) -> DataFrame:
    """Per transcript row: `error` (or null) and `parsed`, holding only the fields of its step.

    Output text goes no further than this; what a step may hold besides its fields (a status page shows
    the database password) is never shuffled nor returned.
    """
    step, code = F.col("step_id"), F.col("code")
    first_line = F.element_at(F.split(js_trim(F.coalesce("stderr", F.lit(""))), "\n", -1), 1)
    required = step.isin(*[s for s, needed in STEPS if needed])
    error = F.when(F.col("transport_error").isNotNull(), F.col("transport_error")).when(
        required & (code != 0), F.concat(F.lit("exit "), code, F.lit(": "), first_line)
    )
    ok = F.col("transport_error").isNull() & (code == 0)
    out = F.when(ok, F.col("stdout"))
    of = lambda name, value: F.when(step == name, value)
    status = computed_once(transcripts, _out=out, _error=error)
    status = computed_once(status, _status=of("drush-status", V.parse_strict(F.col("_out"))))
    out, v = F.col("_out"), F.col("_status")
    parsed = F.struct(
        of("php-version", php_version(out)).alias("php_version"),
        of("php-modules", php_modules(out)).alias("php_extensions"),
        of("drush-version", first_match(out, r"(\d+\.\d+\.\d+)")).alias("drush"),
        F.when(
            V.is_object(v),
            F.struct(
                _status(v, "drupal-version", "drupalVersion").alias("version"),
                _status(v, "install-profile", "installProfile").alias("profile"),
                _status(v, "uri").alias("uri"),
                _status(v, "db-driver", "dbDriver").alias("driver"),
                _status(v, "db-name", "dbName").alias("name"),
            ),
        ).alias("status"),
        of("modules", F.when(out.isNotNull(), module_list(out))).alias("modules"),
        of("files-kb", du_kilobytes(out)).alias("files_kb"),
        of(
            "files-count", last_count(out)
        ).alias("files_count"),
        of("db-bytes", last_count(out)).alias("db_bytes"),
        of("nodes", last_count(out)).alias("nodes"),
        of("image-styles", last_count(out)).alias("image_styles"),
    )
    return status.select("host", "root", "step_id", "captured_at", F.col("_error").alias("error"), parsed.alias("parsed"))


def fold_surveys(transcripts: DataFrame, hosts: DataFrame | None = None) -> DataFrame:
    """One survey per (host, root) from rows (host, root, step_id, code, stdout, stderr, transport_error, captured_at).

    A step without any row is an error of its own, whether required or not; `hosts` (host, root) adds hosts
    that have no row at all.

    Rows are parsed before the shuffle and folded per step, the latest capture of a step winning, so a host
    captured very often is reduced to one small row per task first.
    """
    steps = parse_steps(transcripts)
    # of two captures of one time the greater digest counts, for every field of the step alike
    at = F.struct(F.coalesce("captured_at", F.timestamp_seconds(F.lit(0))), F.xxhash64(F.to_json("parsed"), "error"))
    mine = lambda step, value: F.max_by(value, F.when(F.col("step_id") == step, at))
    field = {
        "php_version": "php-version", "php_extensions": "php-modules", "drush": "drush-version", "status": "drush-status",
        "modules": "modules", "files_kb": "files-kb", "files_count": "files-count", "db_bytes": "db-bytes",
        "nodes": "nodes", "image_styles": "image-styles",
    }
    folded = steps.groupBy("host", "root").agg(
        F.max("captured_at").alias("captured_at"),
        *[mine(step, F.col(f"parsed.{name}")).alias(f"_{name}") for name, step in field.items()],
        *[mine(step, F.col("error")).alias(f"_error_{i}") for i, (step, _) in enumerate(STEPS)],
        *[F.bool_or(F.col("step_id") == step).alias(f"_seen_{i}") for i, (step, _) in enumerate(STEPS)],
    )
    if hosts is not None:
        folded = hosts.select("host", "root").distinct().join(folded, ["host", "root"], "left")
    absent = lambda i: ~F.coalesce(f"_seen_{i}", F.lit(False))
    detail = lambda i, step: F.when(absent(i), F.lit(f"no entry for {step}")).otherwise(F.col(f"_error_{i}"))
    errors = F.filter(
        F.array(
            *[
                F.when(
                    detail(i, step).isNotNull(), F.struct(F.lit(step).alias("id"), detail(i, step).alias("detail"))
                )
                for i, (step, _) in enumerate(STEPS)
            ]
        ),
        lambda e: e.isNotNull(),
    )
    none = F.array().cast("array<string>")
    return folded.select(
        "host",
        "root",
        "captured_at",
        F.struct(
            F.col("_php_version").alias("version"), F.coalesce("_php_extensions", none).alias("extensions")
        ).alias("php"),
        F.col("_drush").alias("drush"),
        F.struct(*[F.col(f"_status.{n}").alias(n) for n in ("version", "profile", "uri")]).alias("drupal"),
        F.struct(
            F.col("_status.driver").alias("driver"),
            F.col("_status.name").alias("name"),
            F.col("_db_bytes").alias("bytes"),
        ).alias("database"),
        F.struct(F.col("_files_kb").alias("kb"), F.col("_files_count").alias("count")).alias("files"),
        F.coalesce("_modules", none).alias("modules"),
        F.col("_nodes").alias("nodes"),
        F.col("_image_styles").alias("image_styles"),
        errors.alias("errors"),
    )
