"""Configs, entitlements, API answers, baselines, checks, probes and inventories on small literal cases."""

import datetime as dt
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from siteferry.functions import scale
from siteferry.operators import baseline, config_rules, gate, inventory, probe
from siteferry.sources.inventory import read_inventory

CANON = {
    "name": "archive-7", "compatibility_flags": ["global_navigator", "nodejs_compat"], "compatibility_date": "2025-11-30",
    "triggers": {"crons": ["17 4 * * 1", "0 * * * *"]}, "main": "edge/own-site.ts", "assets": {"directory": "public"},
    "migrations": [{"tag": "first", "new_sqlite_classes": ["Other", "Vault"]}, {"tag": "second"}],
    "durable_objects": {"bindings": [{"class_name": "Vault", "name": "VAULT"}]},
    "alias": {"./runtime/php-binary.js": "lib/slim.js"},
}


def without(*names, **changes):
    return json.dumps({k: v for k, v in (CANON | changes).items() if k not in names})


def test_configs(spark):
    texts = {
        "good": without(),
        "commented": "// c\n" + without().replace("{", '{/* https:// */"u":"https://x\\"//,}",', 1).replace("}]}", "},],}", 1),
        "diag": without(vars={"PW_DIAGNOSTICS": "1"}), "diag_number": without(vars={"PW_DIAGNOSTICS": 1}),
        "diag_other": without(vars={"PW_DIAGNOSTICS": True}), "plain": without(migrations=[{"new_classes": ["Vault"]}]),
        "unmigrated": without(migrations=[]), "unbound": without(durable_objects={"bindings": []}), "alias": without(alias={}),
        "bare": '{"main": "edge/own-site.ts"}', "empty": "{}", "broken": "{", "array": "[]", "trailing": "{} x",
    }
    df = spark.createDataFrame([(p, "a", t) for p, t in texts.items()], "path string, account string, text string")
    scored = config_rules.score_configs(df)
    got = {r.path: None if r.findings is None else [f.id for f in r.findings] for r in scored.collect()}
    assert got == {
        "good": [], "commented": [], "diag": ["diagnostics-public"], "diag_number": ["diagnostics-public"], "diag_other": [],
        "plain": ["do-not-sqlite"], "unmigrated": ["do-unmigrated"], "unbound": ["do-binding"], "alias": ["interpreter-alias"],
        "bare": ["compatibility-date", "nodejs-compat", "do-binding", "interpreter-alias", "assets", "cron"],
        "empty": ["main", "compatibility-date", "nodejs-compat", "do-binding", "cron"],
        "broken": None, "array": None, "trailing": None,
    }
    checks = {r.subject: (r.ran, r.ok) for r in config_rules.config_check(scored).collect()}
    assert checks["good"] == (True, True) and checks["diag"] == (True, False) and checks["broken"] == (False, False)
    counts = {r.path: (r.blocker, r.failed) for r in config_rules.config_counts(scored).collect()}
    assert counts["empty"] == (2, True) and counts["alias"] == (0, False) and counts["array"] == (None, None)


def test_plan_rule(spark):
    cases = [("free", "paid", "plan-mismatch"), ("FREE", "free", None), (None, "paid", "plan-unset"), ("free", "unknown", "plan-unknown"), ("free", None, None)]
    texts = [(f"c{i}", f"a{i}", without(vars={"PLAN": s} if s else {})) for i, (s, _, _) in enumerate(cases)]
    plans = [(f"a{i}", p) for i, (_, p, _) in enumerate(cases) if p]
    scored = config_rules.score_configs(
        spark.createDataFrame(texts, "path string, account string, text string"), spark.createDataFrame(plans, "account string, plan string")
    )
    got = {r.path: [f.id for f in r.findings] for r in scored.collect()}
    assert got == {f"c{i}": [f] if f else [] for i, (_, _, f) in enumerate(cases)}


def test_entitlements_and_answers(spark):
    subs = [
        ("a", "workers_paid", "Workers Paid"), ("b", "workers_free", None), ("c", "cf_free", "Free Website"), ("d", None, None),
        ("e", None, "Enterprise Website"), ("e", None, "Workers Bundled"),
    ]
    accounts = spark.createDataFrame([(x,) for x in "abcdef"], "account string")
    found = baseline.workers_plan(spark.createDataFrame(subs, "account string, id string, public_name string"), accounts)
    assert {r.account: (r.plan, r.evidence) for r in found.collect()} == {
        "a": ("paid", 1), "b": ("free", 1), "c": ("unknown", 0), "d": ("unknown", 0), "e": ("paid", 1), "f": ("unknown", 0),
    }
    answers = [
        (200, '{"success":true,"result":[]}', "ok", None), (403, "{}", "auth", "HTTP 403; the token was rejected"),
        (403, "<x>", "non-json", "HTTP 403 with a non-JSON body"), (200, '{"success":false,"errors":[{"code":1},{"message":"m"}],"result":1}', "api", "1; m"),
        (500, '{"success":true}', "api", "HTTP 500"), (200, '{"success":"false","result":null}', "ok", None),
    ]
    df = spark.createDataFrame([(s, b) for s, b, *_ in answers], "status int, body string")
    assert [(r.outcome, r.detail) for r in baseline.api_outcome(df).collect()] == [a[2:] for a in answers]


def test_snapshots_and_baseline(spark):
    docs = spark.createDataFrame(
        [("l", '["b","a","",7]'), ("o", '{"workers":["a",{"id":"c"},{"x":1}]}'), ("bad", '{"a":1}'), ("none", "[]")], "account string, text string"
    )
    read = baseline.read_snapshot(docs)
    got = {(r.account, r.readable, r.name) for r in read.collect()}
    assert {g for g in got if g[0] in ("l", "bad", "none")} == {("l", True, "b"), ("l", True, "a"), ("l", True, "7"), ("bad", False, None)}
    assert {("o", True, "a"), ("o", True, "c")} <= got
    names = lambda *ns: spark.createDataFrame([("x", n) for n in ns], "account string, name string")
    diff = baseline.baseline_diff(names("a", "a", "b"), names("b", "c"), ["account", "name"])
    assert {(r.name, r.change) for r in diff.collect()} == {("a", "removed"), ("b", "same"), ("c", "added")}
    accounts = spark.createDataFrame([("x",), ("y",)], "account string")
    assert {(r.account, r.added, r.removed, r.same) for r in baseline.baseline_gate(diff, accounts).collect()} == {("x", 1, 1, False), ("y", 0, 0, True)}


def test_gate(spark):
    rows = [("a", c, True, True) for c in gate.ALL_CHECKS] + [("b", "config", True, False), ("b", "workspace", False, True), ("c", "workspace", True, True)]
    checks = spark.createDataFrame(rows, "subject string, id string, ran boolean, ok boolean")
    got = {r.subject: (r.failed, r.skipped, r.verdict) for r in gate.gate_verdict(gate.gate(checks)).collect()}
    assert got["a"] == ([], [], "ready")
    assert got["b"] == (["config"], ["workspace", "artifacts", "scrub", "bundle"], "validation")
    assert got["c"] == ([], ["artifacts", "config", "scrub", "bundle"], "validation-incomplete")
    only = gate.gate_verdict(gate.gate(checks, only=" workspace , config")).filter("subject = 'c'").first()
    assert (only.skipped, only.verdict) == (["config"], "validation-incomplete")
    assert gate.wanted_checks("dev") == ("workspace", "artifacts", "config")
    with pytest.raises(ValueError, match="unknown check"):
        gate.wanted_checks("workspace,typo")
    assert [r.result for r in gate.check_result(checks.filter("subject = 'b'")).collect()] == ["FAIL", "not run"]


def test_targets_and_verdicts(spark):
    targets = {
        " Example.COM/ ": "https://example.com", "http://a.b:80/sub//": "http://a.b/sub", "https://u:p@h:8443/x?y#z": "https://h:8443/x",
        "": None, "https://": None, "two words": None,
    }
    df = spark.createDataFrame([(t,) for t in targets], "t string").withColumn("o", probe.normalise_target(F.col("t")))
    assert {r.t: r.o for r in df.collect()} == targets
    cases = [
        (503, {"x-cfw-queued": "1"}, "worker", "warming"), (503, {"x-cfw-cache": "MISS"}, "worker", "warming"),
        (503, {"x-cfw-migrate": "31/62"}, "worker", "warming"), (500, {"x-cfw-cache": "HIT"}, "worker", "degraded"),
        (404, {"x-cfw-cache": "DENY"}, "worker", "degraded"), (200, {}, "worker", "not-worker"), (200, {}, "vps", "ok"),
        (None, {}, "vps", "unreachable"), (503, {"x-cfw-cache": "HIT"}, "worker", "degraded"),
    ]
    df = spark.createDataFrame(cases, "s int, h map<string,string>, k string, v string")
    found = df.select("v", probe.verdict_of(F.col("s"), F.col("h"), F.col("k"), F.lit(None).cast("string")).alias("f"))
    assert all(r.v == r.f for r in found.collect())
    numbers = {"12": 12.0, " 1e2 ": 100.0, "": None, "1.0d": None, "Infinity": None, "x": None, "-.5": -0.5}
    df = spark.createDataFrame([(n,) for n in numbers], "n string")
    df = df.withColumn("f", probe.header_number(F.create_map(F.lit("h"), F.col("n")), "h"))
    assert {r.n: r.f for r in df.collect()} == numbers


def test_claims(spark):
    bodies = [
        (200, '{"ok":true,"configured":false}', "unclaimed", None), (200, '{"ok":true,"configured":true,"firstRunAt":1755000000000}', "claimed", 1755000000000),
        (404, '{"ok":true,"configured":true}', "unknown", None), (200, "<html>", "unknown", None), (200, '{"ok":false,"configured":true}', "unknown", None),
        (200, '{"ok":"true","configured":true}', "unknown", None), (None, None, "unknown", None),
    ]
    df = spark.createDataFrame([b[:2] for b in bodies], "s int, b string").select(probe.claim_of(F.col("s"), F.col("b")).alias("c"))
    got = df.select("c.state", F.unix_millis("c.first_run_at").alias("at")).collect()
    assert [tuple(r) for r in got] == [b[2:] for b in bodies]


def test_headers_in_any_case(spark):
    row = (
        "h", "s", "worker", "/serve", 200, 5, {"X-CFW-Cache": "HIT", "x-cfw-PHP-Booted": "0", "X-CFW-V": "2", "Server": "x"}, None, None,
        dt.datetime(2026, 1, 1),
    )
    df = spark.createDataFrame(
        [row], "target string, site string, kind_wanted string, path string, status int, wall_ms long, headers map<string,string>, body string, error string, at timestamp"
    )
    got = probe.health_gate(probe.probe_results(df)).first()
    assert (got.tier, got.php_booted, got.header_version, got.verdict, got.gate) == ("HIT", False, 2.0, "ok", "ok")
    assert got.notes == ["no interpreter booted", "header version is newer than known"]


def test_copy_plan_and_hot_sources(spark):
    inv = lambda **kw: spark.createDataFrame(
        [(k.replace("_", "/"), 1, v) for k, v in kw.items()], "path string, bytes long, sha256 string"
    )
    entries = spark.createDataFrame([("a", f"d/{i}") for i in range(40)] + [("b", "d/b"), ("none", "x"), ("a", "../y")], "from string, to string")
    plan = inventory.copy_plan(entries, inv(a="1", b="2"), inv(d_1="1", d_2="9"))
    got = {r.to: r.verdict for r in plan.collect()}
    assert (got["d/0"], got["d/1"], got["d/2"], got["x"], got["../y"]) == ("create", "identical", "overwrite", "absent", "unsafe")
    saved = inventory.backup_paths(plan, dt.datetime(2026, 1, 2, tzinfo=dt.timezone.utc), "/w").collect()
    assert [tuple(r) for r in saved] == [("d/2", "/w/.backup/20260102T000000000Z/d__2", 1)]
    hot = scale.hot_key_lookup(entries, inv(a="1", b="2").withColumnRenamed("path", "from"), ["from"], ["to"], hot_rows=10)
    assert {r["to"]: r.sha256 for r in hot.collect()} == {r["to"]: {"a": "1", "b": "2"}.get(r["from"]) for r in entries.collect()}


def test_sizes_and_files(spark, tmp_path):
    logs = {
        "Total Upload: 4096.50 KiB / gzip: 1024.25 KiB": 1048832, "gzip: 3.5 MiB": 3670016, "gzip: 512 B": 512, "gzip: 5 Bytes": None, "none": None,
    }
    df = inventory.ceiling(spark.createDataFrame([(x, x) for x in logs], "name string, log string"))
    rows = {r.name: r for r in df.collect()}
    assert {n: r.bytes for n, r in rows.items()} == logs
    assert rows["gzip: 3.5 MiB"].fits_free is False and rows["gzip: 3.5 MiB"].fits_paid and rows["none"].fits_free is None
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "f.bin").write_bytes(b"abc")
    row = read_inventory(spark, str(tmp_path)).first()
    assert (row.bytes, row.sha256[:12]) == (3, "ba7816bf8f01")
    normal = spark.createDataFrame([("./a/../b//c",), ("../x",)], "p string").select(inventory.normalise_path(F.col("p")).alias("n"))
    assert [r.n for r in normal.collect()] == ["b/c", "x"]


def test_digests_of_files_in_any_number_of_blocks(spark, tmp_path):
    rng = random.Random(2)
    files = {"a/one": b"\n", "a/two": b"\n\n", "none": b"", "b": b"x", "c": b"x\n", "d": b"\nx", "e": bytes(range(256)) * 40}
    files |= {f"r{i}": bytes(rng.choice(b"\n\xff\0ab\r") for _ in range(rng.randrange(1, 900))) for i in range(20)}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    wanted = sorted((name.split("/")[-1], len(data), hashlib.sha256(data).hexdigest()) for name, data in files.items())
    for size in ("200", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            got = sorted((r.path.split("/")[-1], r.bytes, r.sha256) for r in read_inventory(spark, str(tmp_path)).collect())
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == [w for w in wanted if w[1]]
