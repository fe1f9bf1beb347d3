"""Queries over command transcripts, one host per customer."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteferry.operators import survey, survey_rules
from siteferry.plans.inputs import derive, each

# Ten steps per host; some are missing, some failed, some hosts were captured twice. `<>` stand for braces
# and `~` for a new line.
each("s", ("n", "step_id"), tuple((n, step) for n, (step, _) in enumerate(survey.STEPS)))
TRANSCRIPTS = """
SELECT concat('host', c_custkey) AS host, '/var/www' AS root, s.step_id AS step_id,
  CASE WHEN (c_custkey + s.n) % 13 = 0 THEN 127 ELSE 0 END AS code,
  CASE WHEN (c_custkey + s.n) % 29 = 0 THEN 'timeout' END AS transport_error,
  'command failed~second line' AS stderr, c.captured AS captured,
  CASE WHEN c.captured = 0 THEN 'PHP 5.3.1 stale' ELSE CASE s.n
    WHEN 0 THEN concat('warning~PHP ', CASE c_custkey % 3 WHEN 0 THEN '8.2.15' WHEN 1 THEN '8.5.1' ELSE '7.4' END, ' (cli)')
    WHEN 1 THEN concat('[PHP Modules]~curl~', CASE WHEN c_custkey % 4 = 0 THEN 'zip~' ELSE '' END,
      'pdo_mysql~~[Zend Modules]~Zend OPcache~')
    WHEN 2 THEN CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE 'Drush Commandline Tool 12.5.1' END
    WHEN 3 THEN CASE WHEN c_custkey % 7 = 0 THEN 'not json' ELSE concat('<"drupal-version":"10.2.1","',
      CASE WHEN c_custkey % 2 = 0 THEN 'db-driver' ELSE 'dbDriver' END, '":"', CASE c_custkey % 5 WHEN 0 THEN 'mysql'
      WHEN 1 THEN 'SQLite' WHEN 2 THEN 'pgsql' WHEN 3 THEN '' ELSE 'mariadb' END,
      '","db-password":"s3cret","uri":"https://site', c_custkey, '"', '>') END
    WHEN 4 THEN CASE c_custkey % 6 WHEN 0 THEN '["views", "node", 7]' WHEN 1 THEN '<"redis":<>,"node":<>,"imagemagick":<>>'
      WHEN 2 THEN '<"views":<>,"backup_migrate":<>>' WHEN 3 THEN 'oops' ELSE '<"views":<>,"node":<>>' END
    WHEN 5 THEN concat(c_custkey * 40, chr(9), '/var/www/sites/default/files')
    WHEN 6 THEN concat('    ', c_custkey)
    WHEN 7 THEN concat('SUM(x)~', c_custkey * 150000)
    WHEN 8 THEN concat('7 of~COUNT(*)~', c_custkey * 10, '~')
    ELSE concat('', c_custkey % 10) END END AS stdout
FROM (SELECT c_custkey, 1 AS captured FROM {customer} UNION ALL
      SELECT c_custkey, 0 AS captured FROM {customer} WHERE c_custkey % 8 = 0) c
@s@
WHERE (c_custkey + s.n) % 17 <> 0"""


def _transcripts(spark, sf_dir):
    made = derive(spark, sf_dir, TRANSCRIPTS, heavy=True)
    stderr = F.translate("stderr", "~", "\n")
    return made.withColumn("stdout", F.translate("stdout", "<>~", "{}\n")).withColumn("stderr", stderr).withColumn(
        "captured_at", F.timestamp_seconds(F.col("captured"))
    )


def _surveys(spark, sf_dir):
    return survey.fold_surveys(_transcripts(spark, sf_dir))


def _survey_fold(spark, sf_dir):
    return _surveys(spark, sf_dir).select(
        "host",
        F.col("php.version").alias("php"),
        F.array_join("php.extensions", ",").alias("extensions"),
        "drush",
        F.col("drupal.version").alias("drupal"),
        F.col("database.driver").alias("driver"),
        F.col("database.bytes").alias("bytes"),
        F.col("files.kb").alias("kb"),
        F.col("files.count").alias("files"),
        F.array_join("modules", ",").alias("modules"),
        "nodes",
        "image_styles",
        F.array_join(F.transform("errors", lambda e: F.concat(e["id"], F.lit("="), e["detail"])), ";").alias("errors"),
    )


def _survey_whitelist(spark, sf_dir):
    """Whether a survey still holds anything that a status page or a stale capture showed beside the fields read."""
    surveys = _surveys(spark, sf_dir)
    leaks = F.to_json(F.struct(*surveys.columns)).rlike("s3cret|db-password|stale")
    fields = ",".join(sorted(surveys.select("drupal.*", "database.*").columns))
    return surveys.select("host", leaks.alias("leaks"), F.lit(fields).alias("status_fields"))


def _scored(spark, sf_dir):
    return survey_rules.score(_surveys(spark, sf_dir), "to-worker")


def _findings(spark, sf_dir):
    return survey_rules.findings(_scored(spark, sf_dir)).select("host", "id", "severity")


def _findings_to_vps(spark, sf_dir):
    found = survey_rules.findings(survey_rules.score(_surveys(spark, sf_dir), "to-vps"))
    return found.groupBy("id", "severity").agg(F.count(F.lit(1)).alias("hosts"))


def _severity_counts(spark, sf_dir):
    return survey_rules.severity_counts(_scored(spark, sf_dir)).drop("root")


def _unknowns(spark, sf_dir):
    listed = survey_rules.unknowns(_surveys(spark, sf_dir))
    return listed.select("host", F.array_join("unknowns", ",").alias("unknowns"))


def _plan_steps(spark, sf_dir):
    surveys = _surveys(spark, sf_dir)
    steps = lambda direction: survey_rules.plan_steps(surveys, direction).select(
        F.lit(direction).alias("direction"), "host", F.col("n").cast("bigint").alias("n"), "title", "command"
    )
    return steps("to-worker").unionByName(steps("to-vps"))


def _blocked(spark, sf_dir):
    return survey_rules.blocked(_scored(spark, sf_dir)).drop("root")


def _ordered_findings(spark, sf_dir):
    found = survey_rules.ordered_findings(survey_rules.findings(_scored(spark, sf_dir)))
    return found.select("host", F.col("severity_rank").cast("bigint").alias("severity_rank"), "id")


def _resolve_target(spark, sf_dir):
    hosts = _surveys(spark, sf_dir).select("host")
    number = F.regexp_extract("host", r"(\d+)", 1).cast("bigint")
    stated = hosts.filter(number % 5 == 0).select("host", F.lit("8.4").alias("php"))
    probed = hosts.filter(number % 3 == 0).select("host", F.lit("8.6.1").alias("php"))
    resolved = survey_rules.resolve_target(hosts, stated, probed)
    return resolved.select("host", F.col("target.php").alias("php"), F.col("target.source").alias("source"))


def _ok(n: int, required_only: str = "") -> str:
    return f"((k + {n}) % 17 <> 0 AND (k + {n}) % 13 <> 0 AND (k + {n}) % 29 <> 0)"


def _when(n: int, value: str) -> str:
    return f"CASE WHEN {_ok(n)} THEN {value} END"


_STEP = (
    "php-version php-modules drush-version drush-status modules files-kb files-count db-bytes nodes image-styles"
).split()
_ERRORS = " || ".join(
    f"""CASE WHEN (k + {i}) % 17 = 0 THEN '{s}=no entry for {s};' WHEN (k + {i}) % 29 = 0 THEN '{s}=timeout;'
  {f"WHEN (k + {i}) % 13 = 0 THEN '{s}=exit 127: command failed;'" if i in (0, 1, 3, 4) else ''} ELSE '' END"""
    for i, s in enumerate(_STEP)
)
# the surveys, worked out from the customer's number alone
_SURVEYS = f"""(
SELECT 'host' || k AS host, k, {_when(0, "CASE k % 3 WHEN 0 THEN '8.2.15' WHEN 1 THEN '8.5.1' END")} AS php,
  coalesce({_when(1, "'curl,' || CASE WHEN k % 4 = 0 THEN 'zip,' ELSE '' END || 'pdo_mysql'")}, '') AS extensions,
  {_when(2, "CASE WHEN k % 5 <> 0 THEN '12.5.1' END")} AS drush, {_when(3, "CASE WHEN k % 7 <> 0 THEN '10.2.1' END")} AS drupal,
  {_when(3, "CASE WHEN k % 7 <> 0 THEN CASE k % 5 WHEN 0 THEN 'mysql' WHEN 1 THEN 'SQLite' WHEN 2 THEN 'pgsql' WHEN 4 THEN 'mariadb' END END")} AS driver,
  {_when(7, "k * 150000")} AS bytes, {_when(5, "k * 40")} AS kb, {_when(6, "k")} AS files,
  coalesce({_when(4, "CASE k % 6 WHEN 0 THEN 'node,views' WHEN 1 THEN 'imagemagick,node,redis' WHEN 2 THEN 'backup_migrate,views' WHEN 3 THEN '' ELSE 'node,views' END")}, '') AS modules,
  {_when(8, "k * 10")} AS nodes, {_when(9, "k % 10")} AS image_styles, rtrim({_ERRORS}, ';') AS errors
FROM (SELECT c_custkey AS k FROM customer) WHERE true)"""

_RULES = f"""
SELECT host, k, 'db-driver' AS id, CASE WHEN driver = 'pgsql' THEN 'blocker' ELSE 'note' END AS severity, 0 AS r FROM {_SURVEYS} WHERE driver IS NOT NULL
UNION ALL SELECT host, k, 'php-version', 'warning', 1 FROM {_SURVEYS} WHERE php = '8.2.15'
UNION ALL SELECT host, k, 'ext-archive', 'warning', 2 FROM {_SURVEYS} WHERE contains(extensions, 'zip')
UNION ALL SELECT host, k, 'incompatible-modules', 'blocker', 3 FROM {_SURVEYS} WHERE contains(modules, 'redis')
UNION ALL SELECT host, k, 'service-modules', 'warning', 4 FROM {_SURVEYS} WHERE contains(modules, 'backup')
UNION ALL SELECT host, k, 'shellout-undetectable', 'note', 5 FROM {_SURVEYS} WHERE modules <> ''
UNION ALL SELECT host, k, 'image-transforms', 'warning', 6 FROM {_SURVEYS} WHERE image_styles * files > 5000
UNION ALL SELECT host, k, 'files-payload', 'warning', 7 FROM {_SURVEYS} WHERE kb * 1024 > 26214400
UNION ALL SELECT host, k, 'database-size', 'warning', 8 FROM {_SURVEYS} WHERE bytes >= 67108864
UNION ALL SELECT host, k, 'regeneration-ceiling', CASE WHEN nodes > 7575 THEN 'warning' ELSE 'note' END, 9 FROM {_SURVEYS} WHERE nodes > 1052
UNION ALL SELECT host, k, 'drush-absent', 'warning', 10 FROM {_SURVEYS} WHERE drush IS NULL
UNION ALL SELECT host, k, 'cron', 'note', 11 FROM {_SURVEYS}"""

_FIELDS = (
    ("php.version", "php IS NULL"), ("drupal.version", "drupal IS NULL"), ("database.driver", "driver IS NULL"),
    ("database.bytes", "bytes IS NULL"), ("files.kb", "kb IS NULL"), ("files.count", "files IS NULL"),
    ("modules", "modules = ''"), ("nodes", "nodes IS NULL"), ("imageStyles", "image_styles IS NULL"),
)

QUERIES = {
    "survey_fold": _survey_fold,
    "survey_whitelist": _survey_whitelist,
    "findings": _findings,
    "findings_to_vps": _findings_to_vps,
    "severity_counts": _severity_counts,
    "unknowns": _unknowns,
    "plan_steps": _plan_steps,
    "blocked": _blocked,
    "ordered_findings": _ordered_findings,
    "resolve_target": _resolve_target,
}

ORACLES = {
    "survey_fold": f"SELECT * EXCLUDE (k) FROM {_SURVEYS}",
    "survey_whitelist": """
SELECT 'host' || c_custkey AS host, false AS leaks, 'bytes,driver,name,profile,uri,version' AS status_fields FROM customer""",
    "findings": f"SELECT host, id, severity FROM ({_RULES})",
    "findings_to_vps": """
SELECT r.id, r.severity, count(*) AS hosts FROM customer, (VALUES ('export-gated', 'blocker'), ('export-structure-only', 'note'),
  ('export-files', 'blocker'), ('hash-salt', 'note'), ('dialect-out', 'note')) r(id, severity) GROUP BY 1, 2""",
    "severity_counts": f"""
SELECT host, count(*) FILTER (WHERE severity = 'blocker') AS blocker, count(*) FILTER (WHERE severity = 'warning') AS warning,
  count(*) FILTER (WHERE severity = 'note') AS note FROM ({_RULES}) GROUP BY host""",
    "unknowns": f"""
SELECT host, rtrim({" || ".join(f"CASE WHEN {c} THEN '{n},' ELSE '' END" for n, c in _FIELDS)}, ',') AS unknowns
FROM {_SURVEYS}""",
    "plan_steps": f"""
SELECT direction, host, CAST(n AS BIGINT) AS n, replace(title, '@uri', uri) AS title, replace(replace(command, '@host', host), '@uri', uri) AS command
FROM (SELECT *, CASE WHEN drupal IS NULL THEN '<site-url>' ELSE 'https://site' || k END AS uri FROM {_SURVEYS}), (VALUES
  ('to-worker', 1, 'write the tables to a file', 'ssh @host drush --root=/var/www sql:dump > @host/tables.sql'),
  ('to-worker', 2, 'find secrets in what will be moved', 'scan_corpus(spark, [''@host''])'),
  ('to-worker', 3, 'respell the tables for SQLite', 'convert(read_dump(spark, ''@host/tables.sql''), ''mysql'', ''sqlite'')'),
  ('to-worker', 4, 'bring the uploads over', 'scp -r @host:/var/www/sites/default/files @host/uploads'),
  ('to-worker', 5, 'put tables and uploads where the site is served from', NULL),
  ('to-worker', 6, 'see how it answers', 'health_gate(probe_results(responses))'),
  ('to-vps', 1, 'have the data handed out for the time of the move', 'DIAGNOSTICS=1 in the settings of the deployment'),
  ('to-vps', 2, 'fetch the tables', 'curl --fail --oauth2-bearer $TOKEN $WORKER/export > @host/tables.sql'),
  ('to-vps', 3, 'respell the tables for MySQL', 'convert(read_dump(spark, ''@host/tables.sql'', ''sqlite''), ''sqlite'', ''mysql'')'),
  ('to-vps', 4, 'fill the database of the host', 'ssh @host drush --root=/var/www sql:query --file=- < @host/tables.mysql.sql'),
  ('to-vps', 5, 'give the site a salt of its own', NULL),
  ('to-vps', 6, 'see how @uri answers', 'probe_results(responses.filter("target = ''@uri''"))')) s(direction, n, title, command)""",
    "blocked": f"SELECT host, bool_or(severity = 'blocker') AS blocked FROM ({_RULES}) GROUP BY host",
    "ordered_findings": f"""
SELECT host, CAST(CASE severity WHEN 'blocker' THEN 1 WHEN 'warning' THEN 2 ELSE 3 END AS BIGINT) AS severity_rank, id
FROM ({_RULES})""",
    "resolve_target": """
SELECT 'host' || c_custkey AS host, CASE WHEN c_custkey % 5 = 0 THEN '8.4' WHEN c_custkey % 3 = 0 THEN '8.6.1' ELSE '8.5' END AS php,
  CASE WHEN c_custkey % 5 = 0 THEN 'stated' WHEN c_custkey % 3 = 0 THEN 'probed' ELSE 'assumed' END AS source FROM customer""",
}
