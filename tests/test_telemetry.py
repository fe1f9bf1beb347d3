"""Captures, CPU summaries, guards and notes."""

import json
import random
import statistics

import pytest
from pyspark.sql import functions as F

from siteferry.operators import telemetry
from siteferry.sources.captures import read_captures
from siteferry.streaming.telemetry import cpu_summary_stream

EVENTS = "capture string, execution_model string, cpu_time double"


def summary(spark, rows, **options):
    found = telemetry.cpu_summary(spark.createDataFrame(rows, EVENTS), **options).collect()
    return {(r.capture, r.execution_model): (r.n, r["median"], r["min"], r["max"], r.spread) for r in found}


def test_four_events(spark):
    rows = [("a", "durableObject", 1398.0), ("a", "durableObject", 22.0), ("a", "durableObject", 34.0), ("a", "stateless", 1.0)]
    assert summary(spark, rows) == {
        ("a", "durableObject"): (3, 34.0, 22.0, 1398.0, 1376.0),
        ("a", "stateless"): (1, 1.0, 1.0, 1.0, 0.0),
    }


def test_even_count_takes_the_mean_of_the_middle(spark):
    assert summary(spark, [("a", "m", 20.0), ("a", "m", 10.0), ("a", "m", None)])[("a", "m")][:2] == (2, 15.0)


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_median_is_exact_on_large_skewed_groups(spark, broadcast_rows):
    """A group far larger than the sketch keeps, one of few distinct values, both join paths."""
    wide = spark.range(120_001).select(
        F.lit("hot").alias("capture"),
        F.lit("m").alias("execution_model"),
        (F.pow(F.pmod(F.xxhash64("id"), F.lit(10_000_019)), F.lit(3)) / 7.0).alias("cpu_time"),
    )
    few = spark.range(60_000).select(F.lit("few"), F.lit("m"), (F.col("id") % 2).cast("double"))
    events = wide.union(few)
    values = [r.cpu_time for r in wide.collect()]
    found = {r.capture: r for r in telemetry.cpu_summary(events, broadcast_rows=broadcast_rows).collect()}
    assert found["hot"]["median"] == statistics.median(values)
    assert found["hot"].n == 120_001
    assert found["few"]["median"] == 0.5


def test_guard_and_notes(spark):
    rows = [
        ("stateless only", "stateless", 1.0), ("one", "durableObject", 5.0), ("untimed", "durableObject", None),
        ("untimed", "stateless", 2.0), ("wide", "durableObject", 0.0), ("wide", "durableObject", 400.5),
        ("wide", "durableObject", 1.0), ("other", "unknown", 3.0),
    ]
    events = spark.createDataFrame(rows, EVENTS)
    captures = spark.createDataFrame([(c,) for c in {r[0] for r in rows} | {"empty"}], "capture string")
    verdict = {r.capture: (r.events, r.instrument_failure, r.usable) for r in telemetry.capture_verdict(events, captures).collect()}
    assert verdict == {
        "stateless only": (1, True, False), "one": (1, False, True), "untimed": (2, True, False),
        "wide": (3, False, True), "other": (1, False, False), "empty": (0, False, False),
    }
    notes = {(r.capture, r.note_id): r.note for r in telemetry.cpu_notes(events, captures).collect()}
    assert set(notes) == {
        ("stateless only", "instrument-failure"), ("untimed", "instrument-failure"), ("one", "few-samples"),
        ("wide", "wide-spread"), ("empty", "empty-capture"),
    }
    assert "n=1" in notes[("one", "few-samples")] and "400.5" in notes[("wide", "wide-spread")]


def test_captures_of_every_form(spark, tmp_path):
    files = {
        "lines.json": '{"executionModel":"stateless","cpuTime":1}\n\nbroken {\n{"cpuTime":"nope"}\n',
        "array.json": '[\n {"executionModel":"durableObject","cpuTime":2.5},\n 7,\n {"outcome":"ok"}\n]',
        "object.json": '{\n "executionModel": "durableObject",\n "cpuTime": 3\n}\n',
        "blank.json": " \n\n",
        "empty.json": "",
        "junk.json": "not json at all",
        "broken_array.json": '[{"cpuTime":1},\n{"cpuTime":2}\n',
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    listing = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in files], "capture string")
    records, status = read_captures(spark, str(tmp_path), listing)
    name = F.regexp_extract("capture", r"([^/]+)$", 1)
    events = telemetry.normalise_events(records).withColumn("capture", name).collect()
    got = sorted(((r.capture, r.execution_model, r.cpu_time, r.outcome) for r in events), key=str)
    assert got == sorted(
        [
            ("lines.json", "stateless", 1.0, None), ("lines.json", "unknown", None, None),
            ("array.json", "durableObject", 2.5, None), ("array.json", "unknown", None, "ok"),
            ("object.json", "durableObject", 3.0, None), ("broken_array.json", "unknown", 2.0, None),
        ],
        key=str,
    )
    state = {r.capture: (r.bad_lines, r.readable) for r in status.withColumn("capture", name).collect()}
    assert state == {
        "lines.json": (1, True), "array.json": (0, True), "object.json": (0, True), "blank.json": (0, True),
        "empty.json": (0, True), "junk.json": (1, False), "broken_array.json": (1, True),
    }
    _, own = read_captures(spark, str(tmp_path))
    assert own.filter("bad_lines > 0").count() == 3 and own.count() == 6


def slow_capture(text):
    """(records, readable) of a capture as a plain reader has them."""
    def parse(t):
        try:
            return [json.loads(t, parse_constant=lambda c: 1 / 0)]
        except (ValueError, ZeroDivisionError):
            return []

    raw = text.strip(" \t\n\r")
    if not raw:
        return [], True
    if raw.startswith("[") and (whole := parse(raw)):
        return whole[0], True
    lines = [r for line in raw.split("\n") for r in parse(line.strip(" \t\n\r"))]
    return (lines, True) if lines else (parse(raw), bool(parse(raw)))


def test_captures_cut_anywhere_have_the_same_records(spark, tmp_path):
    """Arrays, lines and objects with braces, quotes and backslashes in strings, against a plain reader at every block size."""
    rng = random.Random(31)

    def value(depth):
        kind = rng.randrange(7 if depth else 5)
        if kind < 3:
            return rng.choice(["}", "],[", '"', "\\", "é{", "plain", '\\"', ","])
        if kind == 3:
            return rng.randrange(99)
        if kind == 4:
            return rng.choice([None, True, 1.5, {}, []])
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 5 else {f"k{i}}}": value(depth - 1) for i in range(rng.randrange(4))}

    dump = lambda v: json.dumps(v, ensure_ascii=False, indent=rng.choice([None, None, 1]))
    texts = {}
    for i in range(6):
        values = [value(3) for _ in range(rng.randrange(12))]
        texts[f"array{i}"] = dump(values) + rng.choice(["", "\n", " \n"])
        texts[f"lines{i}"] = "\n".join(rng.choice(["", "bad }{", json.dumps(v)]) if rng.random() < 0.2 else json.dumps(v) for v in values)
        text = dump({"a": values})
        texts[f"object{i}"] = text
        broken = dump(values) + "."
        texts[f"broken{i}"] = broken[: rng.randrange(len(broken))] + rng.choice(["", "}", "]", "]}", '"', "[1]"])
    texts["one-line"] = json.dumps([{"n": i, "s": "}" * (i % 5)} for i in range(150)])
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    listing = spark.createDataFrame([(f"file:{tmp_path}/{n}",) for n in texts], "capture string")
    expected = {name: slow_capture(text) for name, text in texts.items()}
    show = lambda v: json.dumps(v, sort_keys=True)
    for size in ("150", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            records, status = read_captures(spark, str(tmp_path), listing, part_pieces=50)
            got = {name: [] for name in texts}
            for r in records.select("capture", F.to_json(F.struct("value")).alias("v")).collect():
                got[r.capture.split("/")[-1]].append(json.loads(r.v).get("value"))
            readable = {r.capture.split("/")[-1]: r.readable for r in status.collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        for name, (values, ok) in expected.items():
            assert sorted(map(show, got[name])) == sorted(map(show, values)), (size, name, texts[name])
            assert readable[name] == ok, (size, name, texts[name])


def test_stream_equals_batch(spark, tmp_path):
    rows = [(f"2026-01-01 00:0{i % 7}:00", "a", "m" if i % 3 else "k", float(i * i)) for i in range(40)]
    df = spark.createDataFrame(rows, "ts string, capture string, execution_model string, cpu_time double").withColumn(
        "ts", F.col("ts").cast("timestamp_ntz")
    )
    df.write.parquet(str(tmp_path / "in"))
    stream = cpu_summary_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("cpu_stream").start()
    run.processAllAvailable()
    run.stop()
    batch = telemetry.cpu_summary(
        df.withColumn("window_start", F.window(F.col("ts").cast("timestamp"), "5 minutes")["start"]), by=("window_start", "capture")
    )
    columns = ["window_start", "execution_model", "n", "median", "min", "max", "spread"]
    key = lambda d: sorted(tuple(r) for r in d.select(*columns).collect())
    assert key(spark.table("cpu_stream")) == key(batch)


def test_a_block_of_captures_is_never_held_whole():
    """Lines and elements come out of a block while its later rows are still to come."""
    import pyarrow as pa

    from siteferry.sources import captures

    record = b'{"executionModel":"view","note":"x", "cpuTime":1'
    columns = {"capture": "f", "place": 0, "shared": False, "size": 10**9, "state": 0, "depth": 0, "opening": None, "surplus": None, "begins": None}
    for first, between, last, kinds in ((b"[", b",", b"]", {"head", "whole", "end"}), (b"", b"\n", b"", {"whole"})):
        taken = 0

        def batches():
            nonlocal taken
            for taken in range(1, 41):
                values = [(b"" if i else first if taken == 1 else between) + (between if i else b"") + record for i in range(10_000)]
                yield pa.RecordBatch.from_pydict({**{n: [v] * len(values) for n, v in columns.items()}, "value": values})
            taken = 41
            yield pa.RecordBatch.from_pydict({**{n: [v] for n, v in columns.items()}, "value": [last or b" "]})

        rows, early = 0, None
        for batch in captures._cut(False)(batches()):
            early = taken if early is None else early
            assert batch.nbytes < 16_000_000
            rows += sum(w == "whole" for w in batch.column("what").to_pylist())
            assert set(batch.column("what").to_pylist()) <= kinds | {"fault"}
        assert early < 20 and rows >= 399_999
