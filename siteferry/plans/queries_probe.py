"""Queries over captured HTTP responses, made from events: one response per event."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteferry.operators import probe
from siteferry.plans.inputs import derive, plain

# The target is one of 30 origins in several spellings; the route, headers and bodies go by event number.
RESPONSES = """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN concat('HTTPS://Site', user_id % 30, '.Example/') WHEN 1 THEN
    concat(' site', user_id % 30, '.example') ELSE concat('https://site', user_id % 30, '.example:443?x=1') END AS target,
  concat('s', user_id % 4) AS site, CASE WHEN event_id % 5 = 4 THEN 'worker' WHEN event_id % 10 = 3 THEN 'vps' ELSE 'auto' END AS kind_wanted,
  CASE WHEN event_id % 10 = 3 THEN '/node/1' WHEN event_id % 10 = 8 THEN '/firstrun?site=s' WHEN event_id % 10 = 7
    THEN '/stats' ELSE '/serve?path=/' END AS path,
  CASE WHEN event_id % 37 = 0 THEN NULL WHEN event_type = 'error' THEN 503 WHEN event_type = 'signup' THEN 404 ELSE 200 END AS status,
  CASE WHEN event_id % 37 = 0 THEN 'timed out' END AS error, event_id % 900 AS wall_ms,
  event_id % 6 AS h, CASE event_id % 4 WHEN 0 THEN '<"ok":true,"configured":true,"firstRunAt":1755000000000>'
    WHEN 1 THEN '<"ok":true,"configured":false>' WHEN 2 THEN '<"ok":false,"configured":true>' ELSE '<html>' END AS body, ts AS seen_at
FROM {events}"""


def _responses(spark, sf_dir):
    made = derive(spark, sf_dir, RESPONSES, heavy=True).withColumnRenamed("seen_at", "at")
    h, none = F.col("h"), F.lit(None).cast("map<string,string>")
    pairs = lambda **kw: F.create_map(*[F.lit(x) for k, v in kw.items() for x in (k.replace("_", "-"), v)])
    headers = (
        F.when(F.col("error").isNotNull(), none)
        .when(F.col("path") == "/node/1", F.when(h % 2 == 0, pairs(X_Generator="Drupal 10")).otherwise(pairs(server="x")))
        .when(h == 0, pairs(X_CFW_Cache="MISS", x_cfw_queue_depth="3", x_cfw_v="2", x_cfw_plan="free"))
        .when(h == 1, pairs(x_cfw_cache="EDGE", x_cfw_generation="1e1", x_cfw_v="1"))
        .when(h == 2, pairs(x_cfw_migrate="31/62", x_cfw_php_booted="0", x_cfw_v=" "))
        .when(h == 3, pairs(x_cfw_queued="1", x_cfw_php_booted="1", x_worker_ms="Infinity"))
        .otherwise(pairs(server="y"))
    )
    return made.withColumn("headers", headers).withColumn("body", F.translate("body", "<>", "{}"))


def _normalise_target(spark, sf_dir):
    origins = _responses(spark, sf_dir).select(probe.normalise_target(F.col("target")).alias("origin"))
    return origins.groupBy("origin").agg(F.count(F.lit(1)).alias("responses"))


def _ordered(spark, sf_dir):
    # events of one instant are told apart by their number
    return _responses(spark, sf_dir).withColumn("at", F.struct("at", "event_id"))


def _results(spark, sf_dir):
    return probe.probe_results(_ordered(spark, sf_dir), time=F.col("at.at"), keep=["event_id"])


def _probe_verdict(spark, sf_dir):
    counted = _results(spark, sf_dir).groupBy("origin", "kind", "verdict")
    return counted.agg(F.count(F.lit(1)).alias("probes"))


def _probe_fields(spark, sf_dir):
    results = _results(spark, sf_dir).withColumn("own_headers", F.size("own").cast("bigint"))
    return results.groupBy(
        "kind", "tier", "generation", "queue_depth", "header_version", "php_booted", "plan", "generator", "diagnostics", "own_headers",
    ).agg(
        F.count(F.lit(1)).alias("probes"), F.sum("wall_ms").alias("wall_ms"), F.count("worker_ms").alias("worker_ms"),
        F.count("path").alias("paths"),
    )


def _probe_notes(spark, sf_dir):
    noted = _results(spark, sf_dir).select("kind", F.explode("notes").alias("note"))
    return noted.groupBy("kind", "note").agg(F.count(F.lit(1)).alias("probes"))


def _claim_state(spark, sf_dir):
    read = probe.claims(_responses(spark, sf_dir))
    ms = F.unix_millis("first_run_at")
    return read.groupBy("origin", "site", "state").agg(F.count(F.lit(1)).alias("answers"), F.max(ms).alias("first_run_ms"))


def _status_record(spark, sf_dir):
    return probe.status_records(_ordered(spark, sf_dir)).select(
        "origin", "site", "reachable", "tier", "claimed", "diagnostics", "finding", F.array_join("notes", "; ").alias("notes")
    )


def _health_counts(spark, sf_dir):
    counted = probe.health_counts(_results(spark, sf_dir).withColumn("at", F.col("at.at")), "1 hour")
    return counted.select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window"), "verdict", "probes")


def _health_gate(spark, sf_dir):
    return probe.health_gate(_results(spark, sf_dir)).groupBy("gate").agg(F.count(F.lit(1)).alias("probes"))


def _latest_probe(spark, sf_dir):
    latest = probe.latest_probe(_results(spark, sf_dir))
    return latest.select("origin", "site", "kind", "verdict", "diagnostics", "event_id")


_R = f"""(SELECT *, 'https://' || lower(regexp_extract(target, '(?i)(site[0-9]+\\.example)', 1)) AS origin,
  row_number() OVER (ORDER BY seen_at, event_id) AS pos FROM {plain(RESPONSES)})"""
_SERVED = f"(SELECT * FROM {_R} WHERE event_id % 10 NOT IN (3, 7, 8))"
_STATS = f"(SELECT *, CASE WHEN status = 404 THEN 'gated' ELSE 'open' END AS state FROM {_R} WHERE event_id % 10 = 7 AND status IS NOT NULL)"
_PLAIN_VERDICT = "CASE WHEN status IS NULL THEN 'unreachable' WHEN status >= 400 THEN 'degraded' ELSE 'ok' END"
_PAGES = f"""(SELECT *, CASE WHEN h % 2 = 0 AND error IS NULL THEN 'vps' ELSE 'unknown' END AS kind, {_PLAIN_VERDICT} AS verdict,
  CASE WHEN h % 2 = 0 AND error IS NULL THEN 'Drupal 10' END AS generator FROM {_R} WHERE event_id % 10 = 3)"""
# answers read as a worker's: g tells their headers, 9 stands for an answer that never came
_DIRECT = f"""(SELECT d.*, coalesce(t.state, 'off') AS diagnostics
FROM (SELECT *, CASE WHEN error IS NOT NULL THEN 9 ELSE h END AS g FROM {_SERVED}
  WHERE kind_wanted = 'worker' OR error IS NOT NULL OR h < 4) d
ASOF LEFT JOIN {_STATS} t ON d.origin = t.origin AND d.site = t.site AND d.pos >= t.pos)"""
_BARE = f"""(SELECT s.event_id, s.origin, s.site, s.seen_at, p.kind, p.verdict, p.generator, p.wall_ms, p.path, p.pos IS NULL AS unseen
FROM (SELECT * FROM {_SERVED} WHERE kind_wanted = 'auto' AND error IS NULL AND h > 3) s
ASOF LEFT JOIN {_PAGES} p ON s.origin = p.origin AND s.pos >= p.pos)"""
_WORKER_VERDICT = """CASE WHEN status IS NULL THEN 'unreachable' WHEN g > 3 THEN 'not-worker' WHEN status = 503 AND g <> 1 THEN 'warming'
  WHEN status >= 400 THEN 'degraded' ELSE 'ok' END"""
_RESULTS = f"""(
SELECT event_id, origin, site, 'worker' AS kind, {_WORKER_VERDICT} AS verdict, NULL AS generator, wall_ms, path, seen_at, g, diagnostics,
  false AS paired, false AS unseen FROM {_DIRECT}
UNION ALL SELECT event_id, origin, site, kind, verdict, generator, wall_ms, path, seen_at, NULL, 'off', false, false FROM {_PAGES}
UNION ALL SELECT event_id, origin, site, coalesce(kind, 'unknown'), verdict, generator, wall_ms, path, seen_at, NULL, 'off', NOT unseen, unseen
FROM {_BARE})"""
_CLAIM = """CASE WHEN status BETWEEN 200 AND 299 AND event_id % 4 = 0 THEN 'claimed' WHEN status BETWEEN 200 AND 299
  AND event_id % 4 = 1 THEN 'unclaimed' ELSE 'unknown' END"""
_LAST = "(seen_at, event_id)"
_SERVE_NOTES = """CASE WHEN error IS NOT NULL THEN [] WHEN h = 0 THEN ['header version is newer than known']
  WHEN h = 1 THEN ['answered by the edge cache']
  WHEN h = 2 THEN ['no interpreter booted', 'replaying the database, chunk 31/62 (unknown)', 'no header version']
  WHEN h = 3 THEN ['no header version'] ELSE ['no worker headers: not a worker', 'no header version'] END"""
_STATUS = f"""(
SELECT k.origin, k.site, coalesce(s.a.status IS NOT NULL, false) AS reachable, CASE s.a.h WHEN 0 THEN 'MISS' WHEN 1 THEN 'EDGE' END AS tier,
  coalesce(c.claim, 'unknown') AS claimed, coalesce(d.state, 'off') AS diagnostics, coalesce(s.a.notes, []) AS notes
FROM (SELECT DISTINCT origin, site FROM {_R} WHERE event_id % 10 <> 3) k
LEFT JOIN (SELECT origin, site, arg_max(struct_pack(status := status, h := CASE WHEN error IS NULL THEN h END, notes := {_SERVE_NOTES}),
  {_LAST}) AS a FROM {_SERVED} GROUP BY 1, 2) s ON s.origin = k.origin AND s.site = k.site
LEFT JOIN (SELECT origin, site, arg_max(struct_pack(state := CASE WHEN status = 404 THEN 'gated' WHEN status IS NOT NULL THEN 'open' END),
  {_LAST}).state AS state FROM {_R} WHERE event_id % 10 = 7 GROUP BY 1, 2) d ON d.origin = k.origin AND d.site = k.site
LEFT JOIN (SELECT origin, site, arg_max({_CLAIM}, {_LAST}) AS claim FROM {_R} WHERE event_id % 10 = 8 GROUP BY 1, 2) c
  ON c.origin = k.origin AND c.site = k.site)"""
_NOTES = (
    ("no worker headers: not a worker", "verdict = 'not-worker'"),
    ("answered by the edge cache", "g = 1"),
    ("no interpreter booted", "g = 2"),
    ("replaying the database, chunk 31/62 (unknown)", "g = 2"),
    ("no header version", "kind = 'worker' AND verdict <> 'unreachable' AND g > 1"),
    ("header version is newer than known", "g = 0"),
    ("the diagnostic routes answered the probe", "diagnostics = 'open'"),
    ("no Drupal header", "kind = 'unknown' AND NOT unseen"),
    ("no worker headers; read as a plain host", "paired"),
    ("no worker headers, and no plain response was captured", "unseen"),
)

QUERIES = {
    "normalise_target": _normalise_target,
    "probe_verdict": _probe_verdict,
    "probe_fields": _probe_fields,
    "probe_notes": _probe_notes,
    "claim_state": _claim_state,
    "status_record": _status_record,
    "health_counts": _health_counts,
    "health_gate": _health_gate,
    "latest_probe": _latest_probe,
}

ORACLES = {
    "normalise_target": f"SELECT origin, count(*) AS responses FROM {_R} GROUP BY 1",
    "probe_verdict": f"SELECT origin, kind, verdict, count(*) AS probes FROM {_RESULTS} GROUP BY 1, 2, 3",
    "probe_fields": f"""
SELECT kind, CASE g WHEN 0 THEN 'MISS' WHEN 1 THEN 'EDGE' END AS tier, CASE g WHEN 1 THEN CAST(10 AS DOUBLE) END AS generation,
  CASE g WHEN 0 THEN CAST(3 AS DOUBLE) END AS queue_depth, CASE g WHEN 0 THEN CAST(2 AS DOUBLE) WHEN 1 THEN CAST(1 AS DOUBLE) END AS header_version,
  CASE g WHEN 2 THEN false WHEN 3 THEN true END AS php_booted, CASE g WHEN 0 THEN 'free' END AS plan, generator, diagnostics,
  CAST(CASE g WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 3 WHEN 3 THEN 2 ELSE 0 END AS BIGINT) AS own_headers, count(*) AS probes,
  CAST(sum(wall_ms) AS BIGINT) AS wall_ms, CAST(0 AS BIGINT) AS worker_ms, count(path) AS paths FROM {_RESULTS} GROUP BY ALL""",
    "probe_notes": "SELECT kind, note, count(*) AS probes FROM ("
    + " UNION ALL ".join(f"SELECT kind, '{n}' AS note FROM {_RESULTS} WHERE {c}" for n, c in _NOTES)
    + ") GROUP BY 1, 2",
    "claim_state": f"""
SELECT origin, site, {_CLAIM} AS state, count(*) AS answers, max(CASE WHEN status BETWEEN 200 AND 299 AND event_id % 4 = 0
  THEN 1755000000000 END) AS first_run_ms FROM {_R} WHERE event_id % 10 = 8 GROUP BY 1, 2, 3""",
    "status_record": f"""
SELECT * EXCLUDE (notes), CASE WHEN NOT reachable THEN 'unreachable' WHEN diagnostics = 'open' THEN 'diagnostics-open'
  WHEN claimed = 'unclaimed' THEN 'unclaimed' END AS finding, array_to_string(notes
  || CASE claimed WHEN 'unclaimed' THEN ['nobody has claimed this site'] WHEN 'unknown' THEN ['no claim state was reported'] ELSE [] END
  || CASE diagnostics WHEN 'open' THEN ['the diagnostic routes answer'] ELSE [] END
  || CASE tier WHEN 'EDGE' THEN ['the EDGE tier does not carry the plan'] ELSE [] END, '; ') AS notes FROM {_STATUS}""",
    "health_counts": f"""
SELECT strftime(date_trunc('hour', seen_at), '%Y-%m-%d %H:%M') AS "window", verdict, count(*) AS probes FROM {_RESULTS} GROUP BY 1, 2""",
    "health_gate": f"""
SELECT CASE WHEN verdict IS NULL THEN 'unknown' WHEN verdict IN ('degraded', 'unreachable') THEN 'unhealthy'
  WHEN verdict = 'not-worker' THEN 'not-worker' ELSE 'ok' END AS gate, count(*) AS probes FROM {_RESULTS} GROUP BY 1""",
    "latest_probe": f"""
SELECT origin, site, r.* FROM (SELECT origin, site, arg_max(struct_pack(kind := kind, verdict := verdict, diagnostics := diagnostics,
  event_id := event_id), (seen_at, event_id)) AS r FROM {_RESULTS} GROUP BY 1, 2)""",
}
