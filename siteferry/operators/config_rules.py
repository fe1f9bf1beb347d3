"""Deployment configs (JSON with comments) scored with rules.

Rules depend on the JSON type of a member, so documents are read as VARIANT. Everything about one document
is worked out inside its row; only the account's plan is looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteferry.functions import variant as V
from siteferry.functions.scale import computed_once, keyed_lookup

# What the rules look for.
NODE_FLAG = "nodejs_compat"
DIAGNOSTICS_VAR = "PW_DIAGNOSTICS"
INTERPRETER_ALIAS = "./runtime/php-binary.js"

_STRING = r'"(?:[^"\\]++|\\[\s\S])*+"'


def clean_jsonc(text: Column) -> Column:
    """The text without comments and trailing commas; what stands in strings is not touched."""
    bare = F.regexp_replace(text, rf"({_STRING})|//[^\n]*|/\*[\s\S]*?(?:\*/|\z)", "$1")
    return F.regexp_replace(bare, rf"({_STRING})|,(\s*[}}\]])", "$1$2")


def parse_configs(configs: DataFrame, text: str = "text") -> DataFrame:
    """Replaces the text by `config` (VARIANT) and `error`, set when it is no JSON object."""
    parsed = computed_once(configs, config=V.parse_strict(clean_jsonc(F.col(text))))
    good = V.is_object(F.col("config"))
    return parsed.withColumn("error", F.when(~good, "not a JSON object")).withColumn(
        "config", F.when(good, F.col("config"))
    ).drop(text)


def _finding(condition: Column, rank: int, id_: str, severity: str, title: Column | str) -> Column:
    shown = F.lit(title) if isinstance(title, str) else title
    return F.when(
        condition,
        F.struct(
            F.lit(rank).alias("rule_rank"), F.lit(id_).alias("id"), F.lit(severity).alias("severity"), shown.alias("title")
        ),
    )


def _variants(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _texts(v: Column, path: str) -> Column:
    strings = F.filter(_variants(v, path), lambda x: F.schema_of_variant(x) == "STRING")
    return F.transform(strings, lambda x: F.try_variant_get(x, "$", "string"))


def score_configs(configs: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """(path, account, error, findings) from configs (path, account, text) and plans (account, plan).

    Without a reading of the account the plan rule is not evaluated. A text that is no object has an error
    and null findings.
    """
    parsed = parse_configs(configs)
    if plans is None:
        parsed = parsed.withColumn("plan", F.lit(None).cast("string"))
    else:
        parsed = keyed_lookup(parsed, plans.select("account", "plan"), ["account"], ["path"])
    v = F.col("config")
    absent = lambda path: V.type_of(v, path).isNull()
    classes = F.filter(
        F.transform(
            _variants(v, "$.durable_objects.bindings"),
            lambda b: F.coalesce(F.try_variant_get(b, "$.class_name", "string"), F.lit("")),
        ),
        lambda c: c != "",
    )
    migrated = lambda member: F.flatten(
        F.transform(_variants(v, "$.migrations"), lambda m: _texts(m, f"$.{member}"))
    )
    read = computed_once(
        parsed,
        _classes=classes,
        _sqlite=migrated("new_sqlite_classes"),
        _plain=migrated("new_classes"),
        _main=V.string_at(v, "$.main"),
        _stated=F.lower(V.string_at(v, "$.vars.PLAN")),
        _flagged=F.array_contains(_texts(v, "$.compatibility_flags"), NODE_FLAG),
    )
    v, main, stated, plan = F.col("config"), F.col("_main"), F.col("_stated"), F.col("plan")
    variable = f"$.vars.{DIAGNOSTICS_VAR}"
    is_open = F.coalesce(V.string_at(v, variable) == "1", F.lit(False)) | F.coalesce(
        V.number_at(v, variable) == 1, F.lit(False)
    )
    site = F.coalesce(main.rlike(r"site\.ts\z"), F.lit(False))

    def of_class(c: Column) -> Column:
        plain = F.array_contains("_plain", c)
        done = F.array_contains("_sqlite", c)
        old = _finding(plain & ~done, 5, "do-not-sqlite", "blocker", F.concat(c, F.lit(" keeps no SQLite")))
        none = _finding(~plain & ~done, 5, "do-unmigrated", "warning", F.concat(c, F.lit(" has no migration")))
        return F.coalesce(old, none)

    known = F.coalesce(plan.isin("free", "paid"), F.lit(False))
    single = [
        _finding(main.isNull() | (main == ""), 0, "main", "blocker", "no main"),
        _finding(~V.is_string(v, "$.compatibility_date"), 1, "compatibility-date", "blocker", "no compatibility_date"),
        _finding(~F.col("_flagged"), 2, "nodejs-compat", "warning", f"no {NODE_FLAG} flag"),
        _finding(is_open, 3, "diagnostics-public", "blocker", f"{DIAGNOSTICS_VAR} is 1"),
        _finding(F.size("_classes") == 0, 4, "do-binding", "warning", "no Durable Object binding"),
    ]
    later = [
        _finding(
            site & absent(f"$.alias['{INTERPRETER_ALIAS}']"),
            6,
            "interpreter-alias",
            "warning",
            f"no alias for {INTERPRETER_ALIAS}",
        ),
        _finding(site & absent("$.assets.directory"), 7, "assets", "warning", "no assets.directory"),
        _finding(absent("$.triggers.crons"), 8, "cron", "note", "no timed trigger"),
        _finding(plan == "unknown", 9, "plan-unknown", "note", "the account plan could not be read"),
        _finding(known & stated.isNull(), 9, "plan-unset", "warning", F.concat(F.lit("no PLAN on the plan "), plan)),
        _finding(
            known & (stated != plan),
            9,
            "plan-mismatch",
            "warning",
            F.concat(F.lit("PLAN says "), stated, F.lit(" on the plan "), plan),
        ),
    ]
    found = F.concat(F.array(*single), F.transform("_classes", of_class), F.array(*later))
    kept = F.when(v.isNotNull(), F.filter(found, lambda f: f.isNotNull()))
    return computed_once(read, findings=kept).select("path", "account", "error", "findings")


def config_findings(scored: DataFrame) -> DataFrame:
    return scored.select("path", "account", F.inline("findings"))


def config_counts(scored: DataFrame) -> DataFrame:
    """Per config the findings of each severity, and `failed` when there is a blocker; null when unread."""
    count = lambda s: F.when(
        F.col("findings").isNotNull(), F.size(F.filter("findings", lambda f: f["severity"] == s)).cast("bigint")
    )
    counted = scored.select("path", "account", "error", *[count(s).alias(s) for s in ("blocker", "warning", "note")])
    return counted.withColumn("failed", F.col("blocker") > 0)


def config_check(scored: DataFrame) -> DataFrame:
    """Each config as one check row (subject, id, ran, ok, title, detail): unread never passes."""
    titles = lambda s: F.transform(
        F.filter("findings", lambda f: f["severity"] == s), lambda f: f["title"]
    )
    blockers, warnings = F.size(titles("blocker")), F.size(titles("warning"))
    ran = F.col("error").isNull()
    ok = ran & (blockers == 0)
    title = (
        F.when(~ran, F.lit("config not checked"))
        .when(blockers > 0, F.concat(blockers, F.lit(" blocker(s)")))
        .when(warnings > 0, F.concat(F.lit("no blockers, "), warnings, F.lit(" warning(s)")))
        .otherwise(F.lit("no blockers"))
    )
    detail = (
        F.when(~ran, F.col("error"))
        .when(blockers > 0, F.array_join(titles("blocker"), "\n"))
        .otherwise(F.array_join(titles("warning"), "\n"))
    )
    return scored.select(
        F.col("path").alias("subject"),
        F.lit("config").alias("id"),
        ran.alias("ran"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
        title.alias("title"),
        detail.alias("detail"),
    )
