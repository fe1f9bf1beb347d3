"""Queries over deployment configs, one per supplier and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteferry.operators import config_rules
from siteferry.plans.inputs import derive, plain

# One config per part, for one of 40 accounts. `<>` stand for braces. Fields go missing, change type or
# hold comment marks inside strings, each on its own modulus.
CONFIGS = """
SELECT concat('p', p_partkey, '.jsonc') AS path, p_partkey % 40 AS account, concat(
  CASE WHEN p_partkey % 31 = 0 THEN '[1] ' ELSE '' END, '< // a config, see https://x', chr(10), '/* block , > */',
  CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '"main": "src/site.ts",' WHEN 2 THEN '"main": "src/other.ts",' ELSE '"main": 5,' END,
  CASE p_partkey % 5 WHEN 0 THEN '"compatibility_date": 20260101,' ELSE '"compatibility_date": "2026-01-01",' END,
  CASE p_partkey % 3 WHEN 0 THEN '"compatibility_flags": "nodejs_compat",' ELSE '"compatibility_flags": ["x", "nodejs_compat",],' END,
  '"vars": <"URL": "https://a//b/*c*/,>"', CASE p_partkey % 6 WHEN 0 THEN ', "PW_DIAGNOSTICS": "1"' WHEN 1 THEN
    ', "PW_DIAGNOSTICS": 1' WHEN 2 THEN ', "PW_DIAGNOSTICS": true' ELSE '' END,
  CASE p_partkey % 7 WHEN 0 THEN '' WHEN 1 THEN ', "PLAN": "PAID"' ELSE ', "PLAN": "free"' END, '>,',
  CASE p_partkey % 8 WHEN 0 THEN '' WHEN 1 THEN '"durable_objects": <"bindings": []>,' ELSE
    '"durable_objects": <"bindings": [<"name": "A", "class_name": "Site">, <"class_name": "Queue">, <"name": "B">]>,' END,
  CASE p_partkey % 9 WHEN 0 THEN '' WHEN 1 THEN '"migrations": [<"new_classes": ["Site"]>, <"new_sqlite_classes": ["Queue"]>],'
    ELSE '"migrations": [<"new_sqlite_classes": ["Site", "Queue", 7]>],' END,
  CASE p_partkey % 11 WHEN 0 THEN '' ELSE '"alias": <"./runtime/php-binary.js": null>,' END,
  CASE p_partkey % 10 WHEN 0 THEN '' ELSE '"assets": <"directory": "a">,' END,
  CASE p_partkey % 12 WHEN 0 THEN '' ELSE '"triggers": <"crons": []>,' END, '>') AS text
FROM {part}"""

PLANS = """
SELECT DISTINCT s_suppkey % 40 AS account, CASE s_suppkey % 40 % 3 WHEN 0 THEN 'free' WHEN 1 THEN 'paid' ELSE 'unknown' END AS plan
FROM {supplier} WHERE s_suppkey % 40 < 30"""


def _scored(spark, sf_dir):
    configs = derive(spark, sf_dir, CONFIGS, heavy=True).withColumn("text", F.translate("text", "<>", "{}"))
    return config_rules.score_configs(configs, derive(spark, sf_dir, PLANS))


def _config_findings(spark, sf_dir):
    return config_rules.config_findings(_scored(spark, sf_dir)).select("path", "id", "severity", "title")


def _config_gate(spark, sf_dir):
    return config_rules.config_counts(_scored(spark, sf_dir)).drop("account")


def _config_check(spark, sf_dir):
    return config_rules.config_check(_scored(spark, sf_dir)).select("subject", "id", "ran", "ok", "title")


_BASE = f"""(SELECT 'p' || p_partkey || '.jsonc' AS path, p_partkey AS k, plan FROM part LEFT JOIN {plain(PLANS)} a
  ON a.account = p_partkey % 40 WHERE p_partkey % 31 <> 0)"""
_CASES = (
    ("main", "blocker", "'no main'", "k % 4 IN (0, 3)"),
    ("compatibility-date", "blocker", "'no compatibility_date'", "k % 5 = 0"),
    ("nodejs-compat", "warning", "'no nodejs_compat flag'", "k % 3 = 0"),
    ("diagnostics-public", "blocker", "'PW_DIAGNOSTICS is 1'", "k % 6 IN (0, 1)"),
    ("do-binding", "warning", "'no Durable Object binding'", "k % 8 IN (0, 1)"),
    ("do-not-sqlite", "blocker", "'Site keeps no SQLite'", "k % 8 > 1 AND k % 9 = 1"),
    ("do-unmigrated", "warning", "'Site has no migration'", "k % 8 > 1 AND k % 9 = 0"),
    ("do-unmigrated", "warning", "'Queue has no migration'", "k % 8 > 1 AND k % 9 = 0"),
    ("interpreter-alias", "warning", "'no alias for ./runtime/php-binary.js'", "k % 4 = 1 AND k % 11 = 0"),
    ("assets", "warning", "'no assets.directory'", "k % 4 = 1 AND k % 10 = 0"),
    ("cron", "note", "'no timed trigger'", "k % 12 = 0"),
    ("plan-unknown", "note", "'the account plan could not be read'", "plan = 'unknown'"),
    ("plan-unset", "warning", "'no PLAN on the plan ' || plan", "plan IN ('free', 'paid') AND k % 7 = 0"),
    (
        "plan-mismatch",
        "warning",
        "'PLAN says ' || CASE WHEN k % 7 = 1 THEN 'paid' ELSE 'free' END || ' on the plan ' || plan",
        "plan IN ('free', 'paid') AND k % 7 <> 0 AND (k % 7 = 1) <> (plan = 'paid')",
    ),
)
_FINDINGS = " UNION ALL ".join(
    f"SELECT path, '{i}' AS id, '{s}' AS severity, {t} AS title FROM {_BASE} WHERE {c}" for i, s, t, c in _CASES
)
_COUNTS = f"""(
SELECT 'p' || p_partkey || '.jsonc' AS path, CASE WHEN p_partkey % 31 = 0 THEN 'not a JSON object' END AS error,
  CASE WHEN p_partkey % 31 <> 0 THEN count(*) FILTER (WHERE f.severity = 'blocker') END AS blocker,
  CASE WHEN p_partkey % 31 <> 0 THEN count(*) FILTER (WHERE f.severity = 'warning') END AS warning,
  CASE WHEN p_partkey % 31 <> 0 THEN count(*) FILTER (WHERE f.severity = 'note') END AS note
FROM part LEFT JOIN ({_FINDINGS}) f ON f.path = 'p' || p_partkey || '.jsonc' GROUP BY p_partkey)"""

QUERIES = {"config_findings": _config_findings, "config_gate": _config_gate, "config_check": _config_check}

ORACLES = {
    "config_findings": _FINDINGS,
    "config_gate": f"SELECT *, blocker > 0 AS failed FROM {_COUNTS}",
    "config_check": f"""
SELECT path AS subject, 'config' AS id, error IS NULL AS ran, coalesce(blocker = 0, false) AS ok,
  CASE WHEN error IS NOT NULL THEN 'config not checked' WHEN blocker > 0 THEN blocker || ' blocker(s)'
    WHEN warning > 0 THEN 'no blockers, ' || warning || ' warning(s)' ELSE 'no blockers' END AS title FROM {_COUNTS}""",
}
