"""Queries over captured execution events."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteferry.functions import variant as V
from siteferry.operators import telemetry
from siteferry.plans.inputs import derive, folders, plain, table
from siteferry.session import staging_path
from siteferry.sources.captures import read_captures
from siteferry.streaming.telemetry import cpu_summary_stream

# Captures are groups of users; every seventh capture loses its durableObject events.
EVENTS = """
SELECT user_id % 20 AS capture,
       CASE WHEN event_type IN ('view', 'click') THEN 'stateless'
            WHEN event_type IN ('purchase', 'signup') AND (user_id % 20) % 7 <> 0 THEN 'durableObject'
            ELSE 'unknown' END AS execution_model,
       CASE WHEN event_id % 11 = 0 THEN NULL ELSE value * 10 END AS cpu_time,
       ts
FROM {events}"""

def _cpu_summary_stream(spark, sf_dir):
    """The stream over the same events, run until all are read.

    A batch writes only the windows that it changed; of each window the last batch counts. What the watermark has
    passed leaves the state.
    """
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]")  # a pattern takes a file and a folder alike
    events = stream.select(
        (F.col("user_id") % 20).alias("capture"),
        F.when(F.col("event_type").isin("view", "click"), telemetry.STATELESS).otherwise(telemetry.DURABLE).alias("execution_model"),
        F.when(F.col("event_id") % 11 != 0, F.col("value") * 10).alias("cpu_time"),
        "ts",
    )
    path = staging_path(spark, "cpu-stream")
    run = (
        cpu_summary_stream(events, "1 day", "1 hour")
        .writeStream.outputMode("update")
        .option("checkpointLocation", staging_path(spark, "cpu-stream-state"))
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{path}/batch={n}"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    written = spark.read.parquet(path)
    key = ["window_start", "capture", "execution_model"]
    rest = F.struct(*[c for c in written.columns if c not in (*key, "batch")])
    done = written.groupBy(*key).agg(F.max_by(rest, "batch").alias("r")).select(*key, "r.*")
    return done.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))


# A captured line per event: some with a field of the wrong type, some not an object, some broken.
LINES = """
SELECT CASE WHEN event_id % 13 = 0 THEN '[1, 2]' WHEN event_id % 17 = 0 THEN '<"cpuTime": 1> tail'
  ELSE concat('<"executionModel":', CASE WHEN event_id % 5 = 0 THEN '7' ELSE concat('"', event_type, '"') END,
       ',"cpuTime":', CASE WHEN event_id % 3 = 0 THEN '"12"' ELSE CAST(event_id % 1000 AS STRING) END,
       ',"outcome":', CASE WHEN event_id % 7 = 0 THEN 'null' ELSE '"ok"' END, '>') END AS line
FROM {events}"""

# More captures were listed than ever produced an event.
CAPTURES = "SELECT DISTINCT c_custkey % 25 AS capture FROM {customer}"


def _cpu_summary(spark, sf_dir):
    return telemetry.cpu_summary(derive(spark, sf_dir, EVENTS))


def _capture_verdict(spark, sf_dir):
    return telemetry.capture_verdict(derive(spark, sf_dir, EVENTS), derive(spark, sf_dir, CAPTURES))


def _cpu_notes(spark, sf_dir):
    notes = telemetry.cpu_notes(derive(spark, sf_dir, EVENTS), derive(spark, sf_dir, CAPTURES))
    return notes.select("capture", "note_rank", "note_id", "execution_model")


def _normalise_events(spark, sf_dir):
    """Events rendered as JSON with fields of the wrong type, parsed and typed again, then counted."""
    lines = derive(spark, sf_dir, LINES).select(F.translate("line", "<>", "{}").alias("line"))
    typed = telemetry.normalise_events(lines.select(V.parse_strict(F.col("line")).alias("value")))
    return typed.groupBy("execution_model", "outcome").agg(
        F.count(F.lit(1)).alias("events"),
        F.count("cpu_time").alias("timed"),
        F.sum(F.col("cpu_time").cast("bigint")).alias("cpu_sum"),
    )


# Files of captured events: lines with broken ones between, arrays, one object, and what is no capture.
CAPTURE_LINES = """
SELECT concat('lines-', user_id % 5) AS dump, event_id + 10 AS ord, concat('<"executionModel":"', event_type, '","cpuTime":',
  event_id % 1000, ',"note":<"t":"> \\\\", [">>') AS line FROM {events}
UNION ALL SELECT concat('lines-', user_id % 5), event_id + 10, 'broken <' FROM {events} WHERE event_id % 9 = 0
UNION ALL SELECT concat('array-', user_id % 3), event_id + 10, concat(CASE WHEN event_id % 2 = 0 THEN ' ' ELSE '' END,
  '<"executionModel":"', event_type, '",', chr(10), '"cpuTime":', event_id % 1000, ',"note":"> \\\\", [">,') FROM {events}
UNION ALL SELECT DISTINCT concat('array-', user_id % 3), 1, '[' FROM {events}
UNION ALL SELECT DISTINCT concat('array-', user_id % 3), 1000000000000, '7]' FROM {events}
UNION ALL SELECT DISTINCT concat('object-', user_id % 10), 1, concat('<', chr(10), '"executionModel": "view",', chr(10), '"cpuTime": 3>')
  FROM {events}
UNION ALL SELECT DISTINCT 'junk', user_id % 10, 'neither' FROM {events}"""


def _captures(spark, sf_dir):
    lines = derive(spark, sf_dir, CAPTURE_LINES).withColumn("line", F.translate("line", "<>", "{}"))
    return read_captures(spark, folders(lines, "captures", files=None))


def _capture_name():
    return F.regexp_extract("capture", "/dump=([^/]*)/", 1).alias("file")


def _read_captures(spark, sf_dir):
    records, _ = _captures(spark, sf_dir)
    events = telemetry.normalise_events(records)
    return events.groupBy(_capture_name(), "execution_model").agg(
        F.count(F.lit(1)).alias("events"), F.sum("cpu_time").alias("cpu_time")
    )


def _capture_files(spark, sf_dir):
    _, status = _captures(spark, sf_dir)
    return status.select(_capture_name(), "lines", "bad_lines", "readable")


QUERIES = {
    "read_captures": _read_captures,
    "capture_files": _capture_files,
    "cpu_summary": _cpu_summary,
    "capture_verdict": _capture_verdict,
    "cpu_notes": _cpu_notes,
    "normalise_events": _normalise_events,
    "cpu_summary_stream": _cpu_summary_stream,
}

_COUNTS = f"""
SELECT c.capture, count(e.capture) AS events,
       count(e.cpu_time) FILTER (WHERE execution_model = 'stateless') AS stateless_n,
       count(e.cpu_time) FILTER (WHERE execution_model = 'durableObject') AS durable_n
FROM {plain(CAPTURES)} c LEFT JOIN {plain(EVENTS)} e USING (capture) GROUP BY c.capture"""

ORACLES = {
    "read_captures": """
SELECT k || '-' || user_id % CASE k WHEN 'lines' THEN 5 ELSE 3 END AS file, event_type AS execution_model, count(*) AS events,
  CAST(sum(event_id % 1000) AS DOUBLE) AS cpu_time FROM events, (VALUES ('lines'), ('array')) x(k) GROUP BY 1, 2
UNION ALL SELECT DISTINCT 'object-' || user_id % 10, 'view', 1, 3.0 FROM events""",
    "capture_files": """
SELECT 'lines-' || user_id % 5 AS file, count(*) + count(*) FILTER (event_id % 9 = 0) AS lines,
  count(*) FILTER (event_id % 9 = 0) AS bad_lines, true AS readable FROM events GROUP BY 1
UNION ALL SELECT 'array-' || user_id % 3, count(*) + 1, 0, true FROM events GROUP BY 1
UNION ALL SELECT DISTINCT 'object-' || user_id % 10, 3, 0, true FROM events
UNION ALL SELECT 'junk', count(DISTINCT user_id % 10), count(DISTINCT user_id % 10), false FROM events""",
    "cpu_summary": f"""
SELECT capture, execution_model, count(*) AS n, median(cpu_time) AS median, min(cpu_time) AS min,
       max(cpu_time) AS max, max(cpu_time) - min(cpu_time) AS spread
FROM {plain(EVENTS)} WHERE cpu_time IS NOT NULL GROUP BY capture, execution_model""",
    "capture_verdict": f"""
SELECT *, stateless_n > 0 AND durable_n = 0 AS instrument_failure,
       NOT (stateless_n > 0 AND durable_n = 0) AND stateless_n + durable_n > 0 AS usable
FROM ({_COUNTS})""",
    "cpu_notes": f"""
WITH v AS ({_COUNTS})
SELECT capture, 1 AS note_rank, 'instrument-failure' AS note_id, CAST(NULL AS VARCHAR) AS execution_model
FROM v WHERE stateless_n > 0 AND durable_n = 0
UNION ALL SELECT capture, 2, 'few-samples', NULL FROM v WHERE durable_n BETWEEN 1 AND 2
UNION ALL SELECT capture, 4, 'empty-capture', NULL FROM v WHERE events = 0
UNION ALL SELECT capture, 3, 'wide-spread', execution_model FROM {plain(EVENTS)}
GROUP BY capture, execution_model HAVING max(cpu_time) - min(cpu_time) > 400""",
    "cpu_summary_stream": """
SELECT strftime(ts, '%Y-%m-%d') AS window_start, capture, execution_model, count(*) AS n, median(cpu_time) AS median,
  min(cpu_time) AS min, max(cpu_time) AS max, max(cpu_time) - min(cpu_time) AS spread
FROM (SELECT ts, user_id % 20 AS capture, CASE WHEN event_type IN ('view', 'click') THEN 'stateless' ELSE 'durableObject' END
  AS execution_model, CASE WHEN event_id % 11 <> 0 THEN value * 10 END AS cpu_time FROM events)
WHERE cpu_time IS NOT NULL GROUP BY 1, 2, 3""",
    "normalise_events": """
SELECT CASE WHEN event_id % 5 = 0 THEN 'unknown' ELSE event_type END AS execution_model,
       CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'ok' END AS outcome, count(*) AS events,
       count(*) FILTER (WHERE event_id % 3 <> 0) AS timed,
       CAST(sum(event_id % 1000) FILTER (WHERE event_id % 3 <> 0) AS BIGINT) AS cpu_sum
FROM events WHERE event_id % 13 <> 0 AND event_id % 17 <> 0 GROUP BY 1, 2""",
}
