"""Queries over name lists, entitlements and check results."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteferry.operators import baseline, gate
from siteferry.plans.inputs import derive, each, plain, table

BEFORE = "SELECT event_type AS account, user_id AS name FROM {events} WHERE event_id % 4 <> 0"
AFTER = "SELECT event_type AS account, user_id AS name FROM {events} WHERE event_id % 4 <> 1"
ACCOUNTS = "SELECT DISTINCT event_type AS account FROM {events} UNION SELECT 'idle' AS account FROM {region}"

SUBSCRIPTIONS = """
SELECT c_nationkey AS account,
       CASE WHEN c_custkey % 5 = 0 THEN 'workers_paid' WHEN c_custkey % 5 = 1 THEN 'workers_free'
            WHEN c_custkey % 5 = 2 THEN NULL ELSE 'images' END AS id,
       CASE WHEN c_custkey % 3 = 0 THEN 'Workers' WHEN c_custkey % 3 = 1 THEN '' ELSE c_mktsegment END AS public_name
FROM {customer} WHERE c_nationkey % 6 <> 0 AND NOT (c_nationkey % 6 = 1 AND c_custkey % 5 < 1)
  AND NOT (c_nationkey % 6 = 2 AND (c_custkey % 5 < 2 OR c_custkey % 3 = 0))"""
NATIONS = "SELECT n_nationkey AS account FROM {nation}"

RESPONSES = """
SELECT event_id, CASE WHEN event_type = 'error' THEN 403 WHEN event_type = 'signup' THEN 500 ELSE 200 END AS status,
       CASE WHEN event_id % 5 = 0 THEN '<html>' WHEN event_id % 5 = 1 THEN '{{"success":true,"result":[]}}'
            WHEN event_id % 5 = 2 THEN '{{"success":false,"errors":[{{"code":10027,"message":"too big"}},{{"code":7}}]}}'
            ELSE '{{"success":true}}' END AS body
FROM {events}"""

_EACH_CHECK = each("c", ("n", "id"), tuple(enumerate(gate.ALL_CHECKS)))
CHECKS = f"""
SELECT s.s_suppkey AS subject, c.id AS id, (s.s_suppkey + c.n) % 7 <> 0 AS ran, (s.s_suppkey * 3 + c.n) % 5 <> 0 AS ok
FROM {{supplier}} s {_EACH_CHECK} WHERE (s.s_suppkey + c.n) % 11 <> 0"""


def _baseline_diff(spark, sf_dir):
    return baseline.baseline_diff(derive(spark, sf_dir, BEFORE), derive(spark, sf_dir, AFTER), ["account", "name"])


def _baseline_gate(spark, sf_dir):
    return baseline.baseline_gate(_baseline_diff(spark, sf_dir), derive(spark, sf_dir, ACCOUNTS))


def _workers_plan(spark, sf_dir):
    return baseline.workers_plan(derive(spark, sf_dir, SUBSCRIPTIONS), derive(spark, sf_dir, NATIONS))


def _plan_evidence(spark, sf_dir):
    return baseline.plan_evidence(derive(spark, sf_dir, SUBSCRIPTIONS))


def _read_snapshot(spark, sf_dir):
    """One saved document per customer: an array, an object with a list, or something else."""
    customer = table(spark, sf_dir, "customer")
    name = F.regexp_replace("c_name", r"[^A-Za-z0-9#]", "")
    documents = customer.select(
        F.col("c_custkey").alias("snapshot"),
        F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit('["'), name, F.lit('", "", "b"]')))
        .when(F.col("c_custkey") % 4 == 1, F.concat(F.lit('{"workers":[{"id":"'), name, F.lit('"}]}')))
        .when(F.col("c_custkey") % 4 == 2, F.lit('{"other":1}'))
        .otherwise(F.lit("[]"))
        .alias("text"),
    )
    return baseline.read_snapshot(documents)


def _api_outcome(spark, sf_dir):
    logged = baseline.api_outcome(derive(spark, sf_dir, RESPONSES))
    return logged.groupBy("outcome", "detail").agg(F.count(F.lit(1)).alias("answers"))


def _gate(spark, sf_dir):
    subjects = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject"))
    report = gate.gate_verdict(gate.gate(derive(spark, sf_dir, CHECKS), subjects))
    return _flat(report)


def _gate_dev(spark, sf_dir):
    subjects = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject"))
    return _flat(gate.gate_verdict(gate.gate(derive(spark, sf_dir, CHECKS), subjects, only="dev")))


def _flat(report):
    return report.select(
        "subject",
        F.array_join("failed", ",").alias("failed"),
        F.array_join("skipped", ",").alias("skipped"),
        "ok",
        "verdict",
    )


def _gate_sql(ids: str) -> str:
    return f"""
WITH wanted AS (SELECT r_regionkey AS n, CASE r_regionkey WHEN 0 THEN 'workspace' WHEN 1 THEN 'artifacts'
    WHEN 2 THEN 'config' WHEN 3 THEN 'scrub' ELSE 'bundle' END AS id FROM region WHERE r_regionkey IN ({ids})),
full_list AS (SELECT s.s_suppkey AS subject, w.n, w.id, coalesce(c.ran, false) AS ran, coalesce(c.ok, false) AS ok
  FROM supplier s CROSS JOIN wanted w LEFT JOIN {plain(CHECKS)} c ON c.subject = s.s_suppkey AND c.id = w.id),
rolled AS (SELECT subject, coalesce(string_agg(id, ',' ORDER BY n) FILTER (WHERE ran AND NOT ok), '') AS failed,
  coalesce(string_agg(id, ',' ORDER BY n) FILTER (WHERE NOT ran), '') AS skipped FROM full_list GROUP BY subject)
SELECT *, failed = '' AS ok, CASE WHEN failed <> '' THEN 'validation' WHEN skipped <> '' THEN 'validation-incomplete'
  ELSE 'ready' END AS verdict FROM rolled"""


_DIFF = f"""
SELECT coalesce(b.account, a.account) AS account, coalesce(b.name, a.name) AS name,
  CASE WHEN b.name IS NULL THEN 'added' WHEN a.name IS NULL THEN 'removed' ELSE 'same' END AS change
FROM (SELECT DISTINCT * FROM {plain(BEFORE)}) b FULL JOIN (SELECT DISTINCT * FROM {plain(AFTER)}) a
  ON a.account = b.account AND a.name = b.name"""

_EVIDENCE = f"""
SELECT account, label, count(*) AS rows, regexp_matches(lower(label),
  'paid|bundled|standard|unlimited|enterprise|business') AS paid
FROM (SELECT account, trim(concat(coalesce(id, ''), ' ', coalesce(public_name, ''))) AS label FROM {plain(SUBSCRIPTIONS)})
WHERE regexp_matches(lower(label), 'workers') GROUP BY account, label"""

QUERIES = {
    "baseline_diff": _baseline_diff,
    "baseline_gate": _baseline_gate,
    "read_snapshot": _read_snapshot,
    "workers_plan": _workers_plan,
    "plan_evidence": _plan_evidence,
    "api_outcome": _api_outcome,
    "gate": _gate,
    "gate_dev": _gate_dev,
}

ORACLES = {
    "baseline_diff": _DIFF,
    "baseline_gate": f"""
SELECT a.account, count(d.change) FILTER (WHERE d.change = 'added') AS added,
  count(d.change) FILTER (WHERE d.change = 'removed') AS removed,
  count(d.change) FILTER (WHERE d.change <> 'same') = 0 AS same
FROM {plain(ACCOUNTS)} a LEFT JOIN ({_DIFF}) d ON d.account = a.account GROUP BY a.account""",
    "read_snapshot": """
SELECT c_custkey AS snapshot, true AS readable, regexp_replace(c_name, '[^A-Za-z0-9#]', '', 'g') AS name
FROM customer WHERE c_custkey % 4 < 2
UNION ALL SELECT c_custkey, true, 'b' FROM customer WHERE c_custkey % 4 = 0
UNION ALL SELECT c_custkey, false, NULL FROM customer WHERE c_custkey % 4 = 2""",
    "workers_plan": f"""
SELECT n.account, CASE WHEN max(e.label) IS NULL THEN 'unknown' WHEN bool_or(e.paid) THEN 'paid' ELSE 'free' END AS plan,
  CAST(coalesce(sum(e.rows), 0) AS BIGINT) AS evidence
FROM {plain(NATIONS)} n LEFT JOIN ({_EVIDENCE}) e ON e.account = n.account GROUP BY n.account""",
    "plan_evidence": _EVIDENCE,
    "api_outcome": f"""
SELECT outcome, CASE outcome WHEN 'non-json' THEN 'HTTP ' || status || ' with a non-JSON body'
    WHEN 'auth' THEN 'HTTP ' || status || '; the token was rejected'
    WHEN 'api' THEN CASE WHEN event_id % 5 = 2 THEN 'too big; 7' ELSE 'HTTP ' || status END END AS detail,
  count(*) AS answers
FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN 403 WHEN event_type = 'signup' THEN 500 ELSE 200 END AS status,
  CASE WHEN event_id % 5 = 0 THEN 'non-json' WHEN event_type = 'error' THEN 'auth'
    WHEN event_id % 5 = 1 THEN 'ok' ELSE 'api' END AS outcome FROM events) GROUP BY 1, 2""",
    "gate": _gate_sql("0, 1, 2, 3, 4"),
    "gate_dev": _gate_sql("0, 1, 2"),
}
