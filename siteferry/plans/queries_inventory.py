"""Queries over inventories made from the documents, site trees and build logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from siteferry.operators import inventory
from siteferry.plans.inputs import derive, each, folders, plain, table
from siteferry.sources.inventory import read_inventory

# Every document is a file; entries say where each goes; the target tree lacks some and differs in others.
SOURCE = """
SELECT concat(source, '/', doc_id, '.txt') AS path, text FROM {documents}"""
ENTRIES = """
SELECT CASE WHEN doc_id % 41 = 0 THEN concat('gone/', doc_id) WHEN doc_id % 3 = 0 THEN concat(source, '/', doc_id, '.txt')
    ELSE (SELECT min(concat(source, '/', doc_id, '.txt')) FROM {documents}) END AS `from`,
  CASE doc_id % 50 WHEN 0 THEN concat('a/../../', doc_id) WHEN 1 THEN concat('/abs/', doc_id) ELSE concat('files/', doc_id % 7, '/', doc_id)
    END AS `to` FROM {documents}"""
TARGET = """
SELECT concat('files/', doc_id % 7, '/', doc_id) AS path, CASE WHEN doc_id % 5 = 0 THEN concat(text, '!') ELSE text END AS text
FROM {documents} WHERE doc_id % 4 <> 0"""
MANIFEST = """
SELECT concat('set', doc_id % 9) AS `set`, concat('files/', doc_id % 7, '/', doc_id) AS path, concat(source, '/', doc_id,
    CASE WHEN doc_id % 10 = 1 AND doc_id % 9 < 4 THEN '.gone' ELSE '.txt' END) AS backup,
  CASE WHEN doc_id % 13 = 0 AND doc_id % 9 < 5 THEN concat(text, '?') ELSE text END AS text
FROM {documents}"""
each(
    "f",
    ("n", "file", "folder"),
    (*((n, p, int(d)) for n, (p, d, _) in enumerate(inventory.REQUIRED_ARTIFACTS)), (8, "assets/core-other/a", 0)),
)
TREES = """
SELECT n_nationkey AS site, concat(f.file, CASE WHEN f.folder = 1 AND n_nationkey % 2 = 0 THEN '/x/y' ELSE '' END) AS path
FROM {nation} @f@
WHERE n_nationkey % 11 <> 5 AND (n_nationkey + f.n) % 6 <> 0"""
LOGS = """
SELECT p_partkey, concat('Total Upload: 11000.00 KiB / ', CASE p_partkey % 5 WHEN 0 THEN concat('gzip: ', p_partkey * 7 + 1000, '.25 KiB')
  WHEN 1 THEN concat('gzip: ', p_partkey % 20, '.5 MiB') WHEN 2 THEN concat('gzip:  ', p_partkey * 9000, ' B') WHEN 3 THEN 'failed'
  ELSE concat('gzip: ', p_partkey, ' Bytes') END) AS log FROM {part}"""

NOW = dt.datetime(2026, 1, 2, 3, 4, 5, 678_000, tzinfo=dt.timezone.utc)


def _digested(df):
    return df.withColumn("bytes", F.octet_length("text").cast("bigint")).withColumn("sha256", F.sha2("text", 256)).drop("text")


def _inventory(spark, sf_dir):
    return _digested(derive(spark, sf_dir, SOURCE))


def _plan(spark, sf_dir):
    return inventory.copy_plan(
        derive(spark, sf_dir, ENTRIES), _inventory(spark, sf_dir), _digested(derive(spark, sf_dir, TARGET))
    )


def _change_set(spark, sf_dir):
    return inventory.change_set(_plan(spark, sf_dir))


def _plan_counts(spark, sf_dir):
    return inventory.plan_counts(_plan(spark, sf_dir))


def _backup_paths(spark, sf_dir):
    return inventory.backup_paths(_plan(spark, sf_dir), NOW)


def _verified(spark, sf_dir):
    return inventory.verify_backup(_digested(derive(spark, sf_dir, MANIFEST)).drop("bytes"), _inventory(spark, sf_dir))


def _verify_backup(spark, sf_dir):
    return _verified(spark, sf_dir).select("set", "path", "state")


def _backup_gate(spark, sf_dir):
    return inventory.backup_gate(_verified(spark, sf_dir))


def _missing_required(spark, sf_dir):
    sites = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("site"))
    return inventory.missing_required(sites, derive(spark, sf_dir, TREES)).select("site", "path")


def _ceiling(spark, sf_dir):
    return inventory.ceiling(derive(spark, sf_dir, LOGS))


def _safe_paths(spark, sf_dir):
    paths = derive(spark, sf_dir, ENTRIES).select(F.col("to").alias("path"))
    return paths.select(
        "path", inventory.is_safe_relative(F.col("path")).alias("safe"), inventory.normalise_path(F.col("path")).alias("normal")
    )


def _sql(select: str) -> str:
    return plain(select.replace("`", '"'))


_SHA = "(SELECT * EXCLUDE (text), sha256(text) AS sha FROM {0})".format
_PLAN = f"""(
SELECT e."from", e."to", CASE WHEN e."to" LIKE '/%' OR list_contains(string_split(e."to", '/'), '..') THEN 'unsafe' WHEN s.sha IS NULL THEN 'absent'
  WHEN t.sha IS NULL THEN 'create' WHEN t.sha = s.sha THEN 'identical' ELSE 'overwrite' END AS verdict, s.bytes, s.sha AS sha256
FROM {_sql(ENTRIES)} e LEFT JOIN (SELECT path, strlen(text) AS bytes, sha256(text) AS sha FROM {_sql(SOURCE)}) s ON s.path = e."from"
LEFT JOIN {_SHA(_sql(TARGET))} t ON t.path = e."to")"""
_STATE = f"""(
SELECT m."set", m.path, CASE WHEN s.sha IS NULL THEN 'missing' WHEN s.sha <> m.sha THEN 'mismatch' ELSE 'ok' END AS state
FROM {_SHA(_sql(MANIFEST))} m LEFT JOIN {_SHA(_sql(SOURCE))} s ON s.path = m.backup)"""
_NEEDED = """(VALUES ('assets/driver.json', 0), ('assets/prefill.json', 0), ('assets/core', 1), ('assets/modules', 1),
  ('assets/drupal-pf/core.pf.json', 0), ('assets/drupal-pf/core.pf.bin', 0), ('assets/drupal-sql', 1), ('assets/drupal/twig-bake.json', 0)) r(path, folder)"""

def _inventory_files(spark, sf_dir):
    """Files made of the documents, read back with their digests."""
    lines = derive(spark, sf_dir, "SELECT concat(source, '-', doc_id % 20) AS dump, doc_id AS ord, text AS line FROM {documents}")
    found = read_inventory(spark, folders(lines, "inventory", files=None))
    return found.select(F.regexp_extract("path", "/dump=([^/]*)/", 1).alias("file"), "bytes", "sha256")


QUERIES = {
    "inventory_files": _inventory_files,
    "inventory": _inventory,
    "copy_plan": _plan,
    "change_set": _change_set,
    "plan_counts": _plan_counts,
    "backup_paths": _backup_paths,
    "verify_backup": _verify_backup,
    "backup_gate": _backup_gate,
    "missing_required": _missing_required,
    "ceiling": _ceiling,
    "safe_paths": _safe_paths,
}

ORACLES = {
    "inventory_files": """
SELECT source || '-' || doc_id % 20 AS file, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes,
  sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS sha256 FROM documents GROUP BY 1""",
    "inventory": f"SELECT path, strlen(text) AS bytes, sha256(text) AS sha256 FROM {_sql(SOURCE)}",
    "copy_plan": f"SELECT * FROM {_PLAN}",
    "change_set": f"""
SELECT "to", CASE verdict WHEN 'identical' THEN 'unchanged' ELSE 'written' END AS action, verdict = 'overwrite' AS backed_up
FROM {_PLAN} WHERE verdict IN ('identical', 'create', 'overwrite')""",
    "plan_counts": "SELECT "
    + ", ".join(
        f"count(*) FILTER (WHERE verdict = '{v}') AS {v}" for v in ("unsafe", "absent", "create", "identical", "overwrite")
    )
    + f""", count(*) FILTER (WHERE verdict = 'overwrite') AS backups, count(*) FILTER (WHERE verdict IN ('unsafe', 'absent')) = 0
  AS applicable FROM {_PLAN}""",
    "backup_paths": f"""
SELECT "to", '.backup/20260102T030405678Z/' || replace("to", '/', '__') AS backup, CAST(1 AS BIGINT) AS copies FROM {_PLAN}
WHERE verdict = 'overwrite'""",
    "verify_backup": f"SELECT * FROM {_STATE}",
    "backup_gate": f"""
SELECT "set", count(*) AS entries, count(*) FILTER (WHERE state <> 'ok') AS problems, bool_and(state = 'ok') AS restorable
FROM {_STATE} GROUP BY 1""",
    "missing_required": f"""
SELECT n_nationkey AS site, r.path FROM nation, {_NEEDED} WHERE NOT EXISTS (SELECT 1 FROM {_sql(TREES)} t
  WHERE t.site = n_nationkey AND CASE r.folder WHEN 0 THEN t.path = r.path ELSE starts_with(t.path, r.path || '/') END)""",
    "ceiling": f"""
SELECT *, bytes <= 3145728 AS fits_free, bytes <= 10485760 AS fits_paid, 3145728 - bytes AS free_headroom, 10485760 - bytes AS paid_headroom
FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN CAST((p_partkey * 7 + 1000.25) * 1024 AS BIGINT)
  WHEN 1 THEN CAST((p_partkey % 20 + 0.5) * 1048576 AS BIGINT) WHEN 2 THEN p_partkey * 9000 END AS bytes FROM {_sql(LOGS)})""",
    "safe_paths": f"""
SELECT "to" AS path, NOT ("to" LIKE '/%' OR "to" LIKE '%/../%') AS safe, CASE WHEN "to" LIKE 'a/%' THEN string_split("to", '/')[-1]
  WHEN "to" LIKE '/%' THEN "to"[2:] ELSE "to" END AS normal FROM {_sql(ENTRIES)}""",
}
