"""Name lists against a saved baseline, entitlement readings and logged API answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteferry.functions import variant as V
from siteferry.functions.text import js_trim

# How a subscription label is read.
WORKERS_LABEL = r"(?i)workers"
PAID_LABEL = r"(?i)paid|bundled|standard|unlimited|enterprise|business"


def baseline_diff(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every distinct key of either side with `change` added, removed or same.

    Both sides go through one aggregate on the whole key, combined before the shuffle, so neither
    copies of a name nor an account with very many names weighs on one task.
    """
    keys = list(keys)
    sides = before.select(*keys, F.lit(True).alias("_was"), F.lit(False).alias("_is")).unionByName(
        after.select(*keys, F.lit(False).alias("_was"), F.lit(True).alias("_is"))
    )
    merged = sides.groupBy(*keys).agg(F.max("_was").alias("_was"), F.max("_is").alias("_is"))
    change = (
        F.when(F.col("_was") & F.col("_is"), "same").when(F.col("_is"), "added").otherwise("removed")
    )
    return merged.select(*keys, change.alias("change"))


def baseline_gate(diff: DataFrame, accounts: DataFrame, account: str = "account") -> DataFrame:
    """Counts and verdict per account of the dimension, so an account with no names is still listed."""
    counts = diff.groupBy(account).agg(
        F.count_if(F.col("change") == "added").alias("added"),
        F.count_if(F.col("change") == "removed").alias("removed"),
    )
    listed = accounts.select(account).distinct().join(counts, account, "left").fillna(0, ["added", "removed"])
    return listed.withColumn("same", (F.col("added") == 0) & (F.col("removed") == 0))


def read_snapshot(documents: DataFrame, text: str = "text") -> DataFrame:
    """Names out of saved snapshots: a JSON array, or an object with a `workers` array.

    Elements are texts or objects with an `id`; empty names are dropped. One row per name, plus the
    document's other columns. A document of any other shape gives one row with `readable` false.
    """
    v = V.parse_strict(F.col(text))
    kept = [c for c in documents.columns if c != text]
    parsed = documents.select(*kept, v.alias("_v"))
    plain = V.is_array(F.col("_v"))
    nested = V.is_array(F.col("_v"), "$.workers")
    items = F.when(plain, F.try_variant_get("_v", "$", "array<variant>")).when(
        nested, F.try_variant_get("_v", "$.workers", "array<variant>")
    )
    names = F.transform(
        items,
        lambda x: F.coalesce(F.when(V.is_object(x), F.try_variant_get(x, "$.id", "string")), F.try_variant_get(x, "$", "string")),
    )
    listed = parsed.select(
        *kept,
        F.coalesce(plain | nested, F.lit(False)).alias("readable"),
        F.filter(names, lambda n: n.isNotNull() & (n != "")).alias("_names"),
    )
    exploded = listed.select(*kept, "readable", F.explode_outer("_names").alias("name"))
    return exploded.filter(F.col("name").isNotNull() | ~F.col("readable"))


def plan_evidence(subscriptions: DataFrame, account: str = "account") -> DataFrame:
    """The labels naming the product, one row per account and distinct label, and what each says."""
    label = js_trim(
        F.concat(F.coalesce("id", F.lit("")), F.lit(" "), F.coalesce("public_name", F.lit("")))
    )
    named = subscriptions.select(account, label.alias("label")).filter(F.col("label").rlike(WORKERS_LABEL))
    return named.groupBy(account, "label").agg(
        F.count(F.lit(1)).alias("rows"), F.max(F.col("label").rlike(PAID_LABEL)).alias("paid")
    )


def workers_plan(subscriptions: DataFrame, accounts: DataFrame, account: str = "account") -> DataFrame:
    """`paid`, `free` or `unknown` per account; no label naming the product is unknown, never free."""
    read = plan_evidence(subscriptions, account).groupBy(account).agg(
        F.max("paid").alias("_paid"), F.sum("rows").alias("evidence")
    )
    plan = F.when(F.col("_paid").isNull(), "unknown").when(F.col("_paid"), "paid").otherwise("free")
    return (
        accounts.select(account)
        .distinct()
        .join(read, account, "left")
        .select(account, plan.alias("plan"), F.coalesce("evidence", F.lit(0)).cast("bigint").alias("evidence"))
    )


def api_outcome(responses: DataFrame, status: str = "status", body: str = "body") -> DataFrame:
    """Logged API answers sorted into non-json, auth, api (with its message) and ok."""
    v = V.parse_strict(F.col(body))
    logged = responses.withColumn("_v", v)
    code = F.col(status)
    refused = F.coalesce(F.try_variant_get("_v", "$.success", "boolean") == F.lit(False), F.lit(False)) & (
        V.type_of(F.col("_v"), "$.success") == "BOOLEAN"
    )
    no_result = V.member(F.col("_v"), "$.result").isNull()
    errors = F.try_variant_get("_v", "$.errors", "array<variant>")
    messages = F.array_join(
        F.transform(
            errors,
            lambda e: F.coalesce(
                F.try_variant_get(e, "$.message", "string"),
                F.try_variant_get(e, "$.code", "string"),
                F.lit("undefined"),
            ),
        ),
        "; ",
    )
    http = F.concat(F.lit("HTTP "), code)
    outcome = (
        F.when(F.col("_v").isNull(), "non-json")
        .when(code.isin(401, 403), "auth")
        .when(refused | no_result, "api")
        .otherwise("ok")
    )
    detail = (
        F.when(F.col("outcome") == "non-json", F.concat(http, F.lit(" with a non-JSON body")))
        .when(F.col("outcome") == "auth", F.concat(http, F.lit("; the token was rejected")))
        .when(F.col("outcome") == "api", F.coalesce(F.nullif(messages, F.lit("")), http))
    )
    return logged.withColumn("outcome", outcome).withColumn("detail", detail).drop("_v")
