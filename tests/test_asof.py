"""Values carried forward in time, and probes paired with the pages before them."""

import datetime as dt
import random

from pyspark.sql import functions as F

from siteferry.functions.asof import carry_last
from siteferry.operators import probe

START = dt.datetime(2026, 3, 1)


def test_carry_last_equals_a_loop(spark):
    rng = random.Random(3)
    rows = []
    for i in range(1500):
        key = rng.choice(["hot"] * 6 + ["a", "b", None])
        at = None if rng.random() < 0.02 else START + dt.timedelta(minutes=rng.randrange(6000) if key == "hot" else rng.randrange(90))
        rows.append((i, key, at, rng.choice([None, None, rng.randrange(100)]), rng.choice([None, f"v{i}"])))
    frame = spark.createDataFrame(rows, "i int, k string, at timestamp, x int, y string")
    expected, last = set(), {}
    for i, key, at, x, y in sorted(rows, key=lambda r: (r[2] is not None, r[2] or START, r[0])):
        before = last.setdefault(key, [None, None])
        for n, v in enumerate((x, y)):
            before[n] = before[n] if v is None else v
        expected.add((i, *before))
    for every in ("hour", "day"):
        got = carry_last(frame, ["k"], F.col("at"), ["at", "i"], ["x", "y"], every)
        assert {(r.i, r.last_x, r.last_y) for r in got.collect()} == expected
    assert carry_last(frame.limit(0), ["k"], F.col("at"), ["at", "i"], ["x"]).count() == 0


SHAPE = (
    "target string, site string, kind_wanted string, path string, status int, wall_ms long, headers map<string,string>, "
    "body string, error string, at timestamp"
)


def response(hours, path, status=200, headers=None, wanted="auto", site="s", error=None, target="h.example"):
    return (target, site, wanted, path, status, 5, headers or {}, None, error, START + dt.timedelta(hours=hours))


def test_later_pages_change_nothing(spark):
    early = [
        response(0, "/serve"), response(1, "/node", 404, {"X-Generator": "Drupal 11"}), response(2, "/serve"), response(60, "/serve"),
        response(70, "/serve", headers={"x-cfw-v": "1"}), response(69, "/stats", 200), response(71, "/serve", headers={"x-cfw-v": "1"}, site="t"),
        response(80, "/other", 200, {}, "vps"), response(81, "/serve"), response(82, "/serve", None, error="refused", wanted="worker"),
        response(83, "/serve", target="no url at all"),
    ]
    late = [response(200, "/node", 500), response(90, "/stats", 404)]

    def results(rows):
        shuffled = random.Random(1).sample(rows, len(rows))
        read = probe.probe_results(spark.createDataFrame(shuffled, SHAPE))
        return [
            ((r.at - START).total_seconds() / 3600, r.kind, r.verdict, r.status, r.diagnostics, r.own, r.notes)
            for r in read.orderBy("at").collect()
        ]

    got = results(early)
    assert [g[:5] for g in got] == [
        (0, "unknown", None, None, "off"), (2, "vps", "degraded", 404, "off"), (60, "vps", "degraded", 404, "off"),
        (70, "worker", "ok", 200, "open"), (71, "worker", "ok", 200, "off"), (80, "unknown", "ok", 200, "off"),
        (81, "unknown", "ok", 200, "off"), (82, "worker", "unreachable", None, "open"), (83, "unknown", None, None, "off"),
    ]
    assert got[3][5:] == ({"x-cfw-v": "1"}, ["the diagnostic routes answered the probe"])
    assert got[0][6] == ["no worker headers, and no plain response was captured"]
    assert results(early + late) == got


def test_status_record_carries_the_notes_of_its_probe(spark):
    rows = [response(1, "/serve", headers={"x-cfw-cache": "EDGE"}), response(0, "/serve"), response(2, "/firstrun", 404)]
    record = probe.status_records(spark.createDataFrame(rows, SHAPE)).first()
    assert record.notes == [
        "answered by the edge cache", "no header version", "no claim state was reported", "the EDGE tier does not carry the plan",
    ]
