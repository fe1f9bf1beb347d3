"""Transcripts to surveys, and surveys to findings."""

import pytest
from pyspark.sql import functions as F

from siteferry.operators import survey, survey_rules

GOOD = {
    "php-version": "PHP 8.2.15 (cli) (built: Jan 1 2026)\nCopyright (c) The PHP Group",
    "php-modules": "[PHP Modules]\ncurl\nzip\npdo_mysql\n\n[Zend Modules]\nZend OPcache",
    "drush-version": "Drush Commandline Tool 12.5.1",
    "drush-status": '{"drupal-version":"10.3.1","db-driver":"mysql","dbName":"drupal","uri":"https://old.example",'
    '"install-profile":"standard","db-password":"s3cret"}',
    "modules": '{"node":{},"views":{},"redis":{}}',
    "files-kb": "40960\t/var/www/html/sites/default/files",
    "files-count": "    1200\n",
    "db-bytes": "SUM(data_length + index_length)\n104857600",
    "nodes": "COUNT(*)\n2000",
    "image-styles": "COUNT(*)\n6",
}
SCHEMA = (
    "host string, root string, step_id string, code int, stdout string, stderr string, transport_error string, "
    "captured_at timestamp"
)


def rows(host, **changes):
    for step, out in GOOD.items():
        code, text, err, lost = changes.get(step.replace("-", "_"), (0, out, "", None))
        yield (host, "/var/www/html", step, code, text, err, lost, None)


@pytest.fixture(scope="module")
def folded(spark):
    made = [
        *rows("good"),
        *rows(
            "bad",
            drush_status=(127, "", "drush: command not found\nmore", None),
            db_bytes=(1, "", "ERROR 1146", None),
            nodes=(0, "", "", "ssh: timed out"),
            modules=(0, '["views","node",3]', "", None),
            php_modules=(0, " [x]\nnope\n[php modules]\r\n a \n[Zend]\nb\n[PHP Modules]\nc", "", None),
            php_version=(0, "PHP eight", "", None),
            image_styles=(0, "3 a\nb 4\n 5", "", None),
        ),
    ]
    hosts = spark.createDataFrame([(h, "/var/www/html") for h in ("good", "bad", "silent")], "host string, root string")
    done = survey.fold_surveys(spark.createDataFrame(made, SCHEMA), hosts).cache()
    return {r.host: r for r in done.collect()}, done


def test_whole_transcript(folded):
    s = folded[0]["good"]
    assert (s.php.version, s.php.extensions) == ("8.2.15", ["curl", "zip", "pdo_mysql"])
    assert (s.drush, s.drupal.version, s.drupal.profile, s.drupal.uri) == ("12.5.1", "10.3.1", "standard", "https://old.example")
    assert (s.database.driver, s.database.name, s.database.bytes) == ("mysql", "drupal", 104857600)
    assert (s.files.kb, s["files"]["count"], s.modules, s.nodes, s.image_styles) == (40960, 1200, ["node", "redis", "views"], 2000, 6)
    assert s.errors == []


def test_failures(folded):
    s = folded[0]["bad"]
    assert [(e.id, e.detail) for e in s.errors] == [
        ("drush-status", "exit 127: drush: command not found"),
        ("nodes", "ssh: timed out"),
    ]
    assert s.database.bytes is None and s.nodes is None and s.php.version is None
    assert s.modules == ["node", "views"] and s.php.extensions == ["a", "c"] and s.image_styles == 5
    assert len(folded[0]["silent"].errors) == 10


def test_no_raw_output_survives(folded):
    assert "s3cret" not in str(folded[0])
    assert not {"stdout", "stderr"} & set(folded[1].columns)


def fields(**kw):
    base = {
        "version": None, "extensions": [], "drush": "12.5.1", "driver": None, "bytes": None, "kb": None, "count": None,
        "modules": [], "nodes": None, "image_styles": None,
    }
    return base | kw


def score(spark, direction="to-worker", **cases):
    schema = (
        "host string, version string, extensions array<string>, drush string, driver string, bytes long, kb long, "
        "count long, modules array<string>, nodes long, image_styles long"
    )
    df = spark.createDataFrame([(h, *fields(**kw).values()) for h, kw in cases.items()], schema).select(
        "host",
        F.lit("/r").alias("root"),
        F.struct("version", "extensions").alias("php"),
        "drush",
        F.struct(F.lit(None).cast("string").alias("version"), F.lit(None).cast("string").alias("uri")).alias("drupal"),
        F.struct("driver", "bytes").alias("database"),
        F.struct("kb", "count").alias("files"),
        "modules",
        "nodes",
        "image_styles",
    )
    scored = survey_rules.score(df, direction)
    found = {h: {} for h in cases}
    for r in survey_rules.findings(scored).collect():
        found[r.host][r.id] = (r.severity, r.title, r.detail)
    return found, scored


def test_rule_edges(spark):
    found, scored = score(
        spark,
        empty={"drush": None},
        my={"driver": "MySQL"}, lite={"driver": "sqlite"}, pg={"driver": "pgsql"},
        images={"image_styles": 10, "count": 2000}, few={"image_styles": 2, "count": 100}, edge={"image_styles": 5, "count": 1000},
        huge={"image_styles": 2**40, "count": 2**40},
        big={"kb": 40960}, small={"kb": 25600}, over={"kb": 25601},
        db={"bytes": 67108864}, dbless={"bytes": 67108863},
        n500={"nodes": 500}, n2000={"nodes": 2000}, n20000={"nodes": 20000},
        mods={"modules": ["imagemagick", "node", "redis", "search_api_solr"]},
        zip={"extensions": ["Phar", "curl", "zip", "phar"]},
        old={"version": "8.4.9"}, same={"version": "8.5.0"}, newer={"version": "9"}, odd={"version": "x.y"},
    )
    ids = lambda h: set(found[h]) - {"cron"}
    assert set(found["empty"]) == {"drush-absent", "cron"}
    assert [found[h]["db-driver"][0] for h in ("my", "lite", "pg")] == ["note", "note", "blocker"]
    assert found["my"]["db-driver"][1] == "tables come out of mysql through the converter"
    assert "20,000" in found["images"]["image-transforms"][1]
    assert not ids("few") and not ids("edge") and not ids("huge")
    assert found["big"]["files-payload"][1] == "uploads take 40 MiB"
    assert not ids("small") and ids("over") == {"files-payload"}
    assert ids("db") == {"database-size"} and not ids("dbless")
    assert not ids("n500") and found["n2000"]["regeneration-ceiling"][0] == "note"
    assert found["n20000"]["regeneration-ceiling"][:2] == ("warning", "20,000 nodes against 1,052 cold renders a day")
    assert ids("mods") == {"incompatible-modules", "service-modules", "shellout-undetectable"}
    assert found["mods"]["incompatible-modules"][1].startswith("2 ")
    assert found["mods"]["incompatible-modules"][2] == "imagemagick: starts a process; redis: needs a raw TCP socket"
    assert found["zip"]["ext-archive"][1] == "archive support in use: Phar, zip"
    assert ids("old") == {"php-version"} and "8.5 (assumed)" in found["old"]["php-version"][2]
    assert not ids("same") and not ids("newer") and ids("odd") == {"php-version"}
    counts = {r.host: (r.blocker, r.warning, r.note) for r in survey_rules.severity_counts(scored).collect()}
    assert counts["pg"] == (1, 0, 1) and counts["empty"] == (0, 1, 1)
    unknown = {r.host: r.unknowns for r in survey_rules.unknowns(scored).collect()}
    assert unknown["empty"] == [n for n, _ in survey_rules.REQUIRED_FIELDS]
    assert "modules" not in unknown["mods"]


def test_other_direction_and_steps(spark):
    found, scored = score(spark, "to-vps", a={})
    assert list(found["a"]) == ["export-gated", "export-structure-only", "export-files", "hash-salt", "dialect-out"]
    assert [r.blocked for r in survey_rules.blocked(scored).collect()] == [True]
    order = [r.severity for r in survey_rules.ordered_findings(survey_rules.findings(scored)).collect()]
    assert order == ["blocker", "blocker", "note", "note", "note"]
    steps = survey_rules.plan_steps(scored, "to-vps").orderBy("n").collect()
    assert len(steps) == 6 and steps[3].command == "ssh a drush --root=/r sql:query --file=- < a/tables.mysql.sql" and steps[4].command is None
    with pytest.raises(ValueError):
        survey_rules.score(scored, "sideways")
