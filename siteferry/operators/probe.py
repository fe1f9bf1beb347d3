"""Captured HTTP responses classified, joined to one record per site, and counted over time.

Input rows are (target, site, kind_wanted, path, status, wall_ms, headers, body, error, at). The path tells
the route: `/serve` is the worker's own, `/stats` and `/firstrun` report its state, any other is a plain page.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siteferry.functions import variant as V
from siteferry.functions.asof import carry_last
from siteferry.functions.scale import computed_once
from siteferry.functions.text import js_trim, let, when_array

# The header prefix, and the newest header contract that is understood.
PREFIX = "x-cfw-"
KNOWN_HEADER_VERSION = 1


def normalise_target(target: Column) -> Column:
    """Scheme, lower-cased host and path without its trailing slashes; null for a text that is no URL."""
    part = lambda url, group: F.regexp_extract(
        url, r"^([A-Za-z]+)://(?:[^/?#]*@)?([^/?#]*)([^?#]*)", group
    )

    def joined(p: Column) -> Column:
        default = F.when(p["scheme"] == "https", ":443").otherwise(":80")
        host = F.when(
            F.endswith(p["host"], default), F.substring(p["host"], F.lit(1), F.length(p["host"]) - F.length(default))
        ).otherwise(p["host"])
        valid = F.rlike(p["host"], F.lit(r"^[^\s:]+(:\d{1,5})?\z"))
        return F.when(valid, F.concat(p["scheme"], F.lit("://"), host, F.regexp_replace(p["path"], r"/+\z", "")))

    parts = lambda url: F.struct(
        F.lower(part(url, 1)).alias("scheme"), F.lower(part(url, 2)).alias("host"), part(url, 3).alias("path")
    )
    with_scheme = lambda raw: F.when(F.rlike(raw, F.lit(r"(?i)^https?://")), raw).otherwise(
        F.concat(F.lit("https://"), raw)
    )
    return let(js_trim(target), lambda raw: let(with_scheme(raw), lambda url: let(parts(url), joined)))


def lower_headers(headers: Column) -> Column:
    """Headers under lower-case names; of names that differ in case only, the last stays."""
    names = F.transform(F.map_keys(headers), F.lower)
    distinct = F.array_distinct(names)
    last = lambda k: F.element_at(
        F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == k), -1
    )["value"]
    merged = F.map_from_arrays(distinct, F.transform(distinct, last))
    plain = F.map_from_arrays(names, F.map_values(headers))
    return F.when(headers.isNull(), F.create_map().cast("map<string,string>")).otherwise(
        F.when(F.size(distinct) == F.size(names), plain).otherwise(merged)
    )


def own_headers(headers: Column) -> Column:
    """The worker's headers out of lower-cased ones."""
    return F.map_filter(headers, lambda k, _: F.startswith(k, F.lit(PREFIX)))


def header_number(headers: Column, name: str) -> Column:
    """A header as a finite number, else null."""
    text = js_trim(F.try_element_at(headers, F.lit(name)))
    return F.when(text.rlike(r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\z"), text.try_cast("double"))


def verdict_of(status: Column, own: Column, kind: Column, error: Column) -> Column:
    """unreachable, not-worker, warming, degraded or ok; the order matters."""
    of = lambda name: F.try_element_at(own, F.lit(PREFIX + name))
    filling = (of("queued") == "1") | (of("cache") == "MISS") | of("migrate").isNotNull()
    return (
        F.when(error.isNotNull() | status.isNull(), "unreachable")
        .when((kind == "worker") & (F.size(own) == 0), "not-worker")
        .when((status == 503) & F.coalesce(filling, F.lit(False)), "warming")
        .when(status >= 400, "degraded")
        .otherwise("ok")
    )


def route_of(path: Column) -> Column:
    return (
        F.when(path.rlike(r"^/serve(?:\?|\z)"), "serve")
        .when(path.rlike(r"^/stats(?:\?|\z)"), "stats")
        .when(path.rlike(r"^/firstrun(?:\?|\z)"), "firstrun")
        .otherwise("plain")
    )


def prepare(responses: DataFrame, *routes: str) -> DataFrame:
    """The responses of some routes with `origin`, `route`, lower-cased `headers` and the worker's `own` headers."""
    routed = responses.withColumn("route", route_of(F.col("path"))).filter(F.col("route").isin(*routes))
    ready = computed_once(
        routed.withColumnRenamed("headers", "_raw"),
        origin=normalise_target(F.col("target")),
        headers=lower_headers(F.col("_raw")),
    ).drop("_raw")
    return ready.withColumn("own", own_headers(F.col("headers")))


def _plain_fields(headers: Column) -> dict[str, Column]:
    of = lambda name: F.try_element_at(headers, F.lit(name))
    return {
        "generator": of("x-generator"),
        "drupal_cache": of("x-drupal-cache"),
        "drupal_dynamic_cache": of("x-drupal-dynamic-cache"),
    }


def _worker_fields() -> dict[str, Column]:
    own = F.col("own")
    of = lambda name: F.try_element_at(own, F.lit(PREFIX + name))
    return {
        "tier": of("cache"),
        "edge_tier": of("edge"),
        "generation": header_number(own, PREFIX + "generation"),
        "render_ms": header_number(own, PREFIX + "render-ms"),
        "serve_ms": header_number(own, PREFIX + "serve-ms"),
        "worker_ms": header_number(F.col("headers"), "x-worker-ms"),
        "php_booted": of("php-booted") == "1",
        "queue_depth": header_number(own, PREFIX + "queue-depth"),
        "header_version": header_number(own, PREFIX + "v"),
        "plan": of("plan"),
    }


def _worker_notes(verdict: Column, diagnostics: Column) -> Column:
    """Notes of a worker's answer, from its own headers and the fields read from them."""
    of = lambda name: F.try_element_at(F.col("own"), F.lit(PREFIX + name))
    fields = _worker_fields()
    edge = F.coalesce(fields["tier"] == "EDGE", F.lit(False))
    version = fields["header_version"]
    return when_array(
        (verdict == "not-worker", F.lit("no worker headers: not a worker")),
        (edge, F.lit("answered by the edge cache")),
        ((fields["php_booted"] == F.lit(False)) & ~edge, F.lit("no interpreter booted")),
        (
            of("migrate").isNotNull(),
            F.concat(
                F.lit("replaying the database, chunk "),
                of("migrate"),
                F.lit(" ("),
                F.coalesce(of("migrate-state"), F.lit("unknown")),
                F.lit(")"),
            ),
        ),
        ((verdict != "unreachable") & version.isNull(), F.lit("no header version")),
        (version > KNOWN_HEADER_VERSION, F.lit("header version is newer than known")),
        (diagnostics == "open", F.lit("the diagnostic routes answered the probe")),
    )


def _stats_state() -> Column:
    """What an answer of `/stats` says about the diagnostic routes; null where there was none."""
    reached = F.col("error").isNull() & F.col("status").isNotNull()
    return F.when((F.col("route") == "stats") & reached, F.when(F.col("status") == 404, "gated").otherwise("open"))


def probe_results(responses: DataFrame, time: Column | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One result per probe: kind, verdict, fields, own headers, diagnostics and notes; `keep` names further columns.

    A probe of kind `auto` whose answer has no worker header is paired with the last plain response of its origin at
    or before it (of several of one time, the one with the greatest path, status and wall time), so a later page never
    changes it; where there was none the verdict stays null. `diagnostics` of a worker's answer is what the last
    `/stats` of its site up to then said: open, gated, or off where it was not asked. Both are carried forward in one
    sorted pass. `time` is the time of a response where `at` is not a timestamp.
    """
    ready = prepare(responses, "serve", "plain", "stats")
    route, own, error = F.col("route"), F.col("own"), F.col("error")
    bare = (route == "serve") & (F.size(own) == 0) & error.isNull() & (F.col("kind_wanted") == "auto")
    bare = F.coalesce(bare, F.lit(False))
    as_worker = (route == "serve") & ~bare & F.coalesce(F.col("kind_wanted") != "vps", F.lit(False))
    as_plain = (route == "plain") & F.coalesce(F.col("kind_wanted") == "vps", F.lit(False))
    page_fields = _plain_fields(F.col("headers"))
    page = F.struct("path", "status", "wall_ms", "error", *[c.alias(n) for n, c in page_fields.items()])
    fields = _worker_fields()
    small = ready.select(
        "origin", "site", "path", "at", "status", "wall_ms", "error", "headers", "own", *keep,
        (F.col("at") if time is None else time).alias("_time"),
        F.when(bare, "bare").when(as_worker, "worker").when(as_plain, "vps").alias("_as"),
        F.when(route == "plain", page).alias("_page"),
        _stats_state().alias("_stats"),
        # pages meet the probes of their origin, answers of /stats those of their site
        F.when((route == "plain") | bare, F.lit("")).otherwise(F.concat(F.lit("="), F.coalesce("site", F.lit("")))).alias("_lane"),
        F.when((route == "plain") | (route == "stats"), 0).otherwise(1).alias("_turn"),
    ).filter(F.col("_as").isNotNull() | F.col("_page").isNotNull() | F.col("_stats").isNotNull())
    order = ["_time", "at", "_turn", "path", "status", "wall_ms"]
    carried = carry_last(small, ["origin", "_lane"], F.col("_time"), order, ["_page", "_stats"])
    probes = carried.filter(F.col("_as").isNotNull())
    kind = F.col("_as")
    # a plain result is read from its own page, or from the page that a bare answer is paired with
    seen = F.when(kind != "worker", F.when(kind == "vps", F.col("_page")).otherwise(F.col("last__page")))
    read = computed_once(probes, _seen=seen)
    seen, worker = F.col("_seen"), kind == "worker"
    unseen = (kind == "bare") & seen.isNull()
    of_page = {n: seen[n] for n in ("generator", "drupal_cache", "drupal_dynamic_cache")}
    drupal = F.coalesce(*of_page.values()).isNotNull()
    none = F.create_map().cast("map<string,string>")
    diagnostics = F.when(worker, F.coalesce("last__stats", F.lit("off"))).otherwise("off")
    verdict = F.when(worker, verdict_of(F.col("status"), own, F.lit("worker"), error)).when(
        seen.isNotNull(), verdict_of(seen["status"], none, F.lit("vps"), seen["error"])
    )
    told = computed_once(read, verdict=verdict, diagnostics=diagnostics)
    plain_notes = when_array(
        (~drupal & ~unseen, F.lit("no Drupal header")),
        ((kind == "bare") & ~unseen, F.lit("no worker headers; read as a plain host")),
        (unseen, F.lit("no worker headers, and no plain response was captured")),
    )
    of = lambda name: F.when(worker, F.col(name)).otherwise(seen[name])
    return told.select(
        "origin",
        "site",
        of("path").alias("path"),
        "at",
        F.when(worker, "worker").when(drupal, "vps").otherwise("unknown").alias("kind"),
        "verdict",
        of("status").alias("status"),
        of("wall_ms").alias("wall_ms"),
        *[F.when(worker, c).alias(n) for n, c in fields.items()],
        F.when(worker, _plain_fields(F.col("headers"))["generator"]).otherwise(of_page["generator"]).alias("generator"),
        *[of_page[n].alias(n) for n in ("drupal_cache", "drupal_dynamic_cache")],
        F.when(worker, own).otherwise(none).alias("own"),
        "diagnostics",
        F.when(worker, _worker_notes(F.col("verdict"), F.col("diagnostics"))).otherwise(plain_notes).alias("notes"),
        *keep,
    )


def claim_of(status: Column, body: Column) -> Column:
    """struct<state, first_run_at>: claimed or unclaimed only on a well-formed positive answer."""
    v = V.parse_strict(body)
    ok = (status >= 200) & (status < 300) & (V.type_of(v, "$.ok") == "BOOLEAN") & F.try_variant_get(v, "$.ok", "boolean")
    configured = F.when(
        V.type_of(v, "$.configured") == "BOOLEAN", F.try_variant_get(v, "$.configured", "boolean")
    )
    known = F.coalesce(ok & configured.isNotNull(), F.lit(False))
    return F.struct(
        F.when(~known, "unknown").when(configured, "claimed").otherwise("unclaimed").alias("state"),
        F.when(known, F.timestamp_millis(V.number_at(v, "$.firstRunAt").cast("bigint"))).alias("first_run_at"),
    )


def claims(responses: DataFrame) -> DataFrame:
    """The claim state each `/firstrun` response reports."""
    asked = prepare(responses, "firstrun")
    state = F.when(F.col("error").isNull(), claim_of(F.col("status"), F.col("body"))).otherwise(
        claim_of(F.lit(None).cast("int"), F.lit(None).cast("string"))
    )
    return computed_once(asked, _claim=state).select("origin", "site", "at", "_claim.*")


def status_records(responses: DataFrame) -> DataFrame:
    """One record per (origin, site): the latest `/serve`, `/stats` and `/firstrun` answers together, with the notes of all.

    Each response is reduced to a few fields and folded by its time in one aggregate, combined before the
    shuffle, so a site with very many responses is no heavier than another.
    """
    ready = prepare(responses, "serve", "stats", "firstrun")
    route, at = F.col("route"), F.col("at")
    fields = _worker_fields()
    keep = ("tier", "generation", "plan", "header_version", "php_booted")
    reached = F.col("error").isNull() & F.col("status").isNotNull()
    verdict = verdict_of(F.col("status"), F.col("own"), F.lit("worker"), F.col("error"))
    small = ready.select(
        "origin",
        "site",
        "route",
        "at",
        F.when(
            route == "serve",
            F.struct(reached.alias("reachable"), _worker_notes(verdict, F.lit("off")).alias("notes"), *[fields[k].alias(k) for k in keep]),
        ).alias("_serve"),
        _stats_state().alias("_stats"),
        F.when((route == "firstrun") & reached, claim_of(F.col("status"), F.col("body"))).alias("_claim"),
    )
    last = lambda name, which: F.max_by(name, F.when(route == which, at))
    folded = small.groupBy("origin", "site").agg(
        last("_serve", "serve").alias("_serve"), last("_stats", "stats").alias("_stats"), last("_claim", "firstrun").alias("_claim")
    )
    read = folded.select(
        "origin",
        "site",
        F.coalesce("_serve.reachable", F.lit(False)).alias("reachable"),
        *[F.col(f"_serve.{k}").alias(k) for k in keep],
        F.coalesce("_claim.state", F.lit("unknown")).alias("claimed"),
        F.col("_claim.first_run_at").alias("first_run_at"),
        F.coalesce("_stats", F.lit("off")).alias("diagnostics"),
        F.coalesce("_serve.notes", F.array().cast("array<string>")).alias("_notes"),
    )
    notes = when_array(
        (F.col("claimed") == "unclaimed", F.lit("nobody has claimed this site")),
        (F.col("claimed") == "unknown", F.lit("no claim state was reported")),
        (F.col("diagnostics") == "open", F.lit("the diagnostic routes answer")),
        (
            F.col("plan").isNull() & F.col("tier").isNotNull(),
            F.concat(F.lit("the "), "tier", F.lit(" tier does not carry the plan")),
        ),
    )
    finding = (
        F.when(~F.col("reachable"), "unreachable")
        .when(F.col("diagnostics") == "open", "diagnostics-open")
        .when(F.col("claimed") == "unclaimed", "unclaimed")
    )
    return read.withColumn("notes", F.concat("_notes", notes)).drop("_notes").withColumn("finding", finding)


def health_gate(results: DataFrame) -> DataFrame:
    """Adds `gate`: unhealthy, not-worker, unknown (no verdict) or ok; warming passes."""
    verdict = F.col("verdict")
    return results.withColumn(
        "gate",
        F.when(verdict.isin("degraded", "unreachable"), "unhealthy")
        .when(verdict == "not-worker", "not-worker")
        .when(verdict.isNull(), "unknown")
        .otherwise("ok"),
    )


def latest_probe(results: DataFrame, order: Sequence[str] = ("at", "path", "kind", "verdict")) -> DataFrame:
    """The latest result of each (origin, site); columns of `order` after the time decide between results of one time."""
    rest = [c for c in results.columns if c not in ("origin", "site")]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return results.groupBy("origin", "site").agg(last).select("origin", "site", "_r.*")


def health_counts(results: DataFrame, window: str = "1 hour") -> DataFrame:
    """Verdicts per time window; runs on a batch or a stream."""
    counted = results.groupBy(F.window("at", window).alias("_w"), "verdict").agg(F.count(F.lit(1)).alias("probes"))
    return counted.select(F.col("_w.start").alias("window_start"), "verdict", "probes")
