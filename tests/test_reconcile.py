"""The row diff must see every planted defect, and nothing on equal tables."""

import pytest
from pyspark.sql import functions as F

from siteferry.operators import reconcile

ROWS = [
    (1, "it's; a quote and a semicolon", bytes.fromhex("000A00FF1A0D"), "plain", "1.5000", 0.5),
    (2, "C:\\path\\to\\file", bytes.fromhex("DEADBEEF"), "a\0b", "-2.2500", -1.25),
    (9007199254740993, "2^53 + 1", b"\0", "emoji and a final sigma: \U0001f418ς", "0.0001", 3.0),
    (9223372036854775807, "BIGINT max", b"", "", "99999999999999.9999", 0.0),
    (-9007199254740993, "negative beyond 2^53", b"\n\n\n", "-- not a comment\n# nor this", "0.0000", -0.0),
]
SCHEMA = "id bigint, label string, payload binary, note string, amount string, ratio double"
BYTES = ["label", "payload", "note"]


@pytest.fixture(scope="module")
def seed(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def diff(expected, actual, **options):
    found = reconcile.diff_rows(expected, actual, ["id"], BYTES, **options).collect()
    return {(r.id, r.column, r.expected, r.actual, r.is_truncated) for r in found}


def test_equal_tables(seed):
    assert diff(seed, seed) == set()


def test_no_rows_at_all(spark, seed):
    assert diff(seed, spark.createDataFrame([], SCHEMA)) == {(r[0], "*", "present", "missing", False) for r in ROWS}


@pytest.mark.parametrize("broadcast_rows", [0, 1000])
def test_planted_defects(spark, seed, broadcast_rows):
    damaged = [
        (1, ROWS[0][1], ROWS[0][2][:2], *ROWS[0][3:]),
        (9007199254740993, ROWS[2][1], ROWS[2][2], "??", *ROWS[2][4:]),
        (9223372036854775807, ROWS[3][1], None, None, *ROWS[3][4:]),
        ROWS[4],
        ROWS[4],
        (77, "extra", b"", "", "0", 0.0),
    ]
    got = diff(seed, spark.createDataFrame(damaged, SCHEMA), broadcast_rows=broadcast_rows)
    assert got == {
        (1, "payload", "000A00FF1A0D", "000A", True),
        (2, "*", "present", "missing", False),
        (9007199254740993, "note", ROWS[2][3].encode().hex().upper(), "3F3F", False),
        (9223372036854775807, "payload", "", None, False),
        (9223372036854775807, "note", "", None, False),
        (-9007199254740993, "*", "unique", "2 rows", False),
        (77, "*", "absent", "unexpected row", False),
    }


def test_cut_at_a_nul_is_a_truncation(spark, seed):
    cut = seed.withColumn("note", F.when(F.col("id") == 2, "a").otherwise(F.col("note")))
    assert diff(seed, cut) == {(2, "note", "610062", "61", True)}


def test_null_does_not_move_between_columns(spark):
    a = spark.createDataFrame([(1, None, "x")], "id int, p string, q string")
    b = spark.createDataFrame([(1, "x", None)], "id int, p string, q string")
    assert reconcile.diff_rows(a, b, ["id"], ["p", "q"]).count() == 2


def test_numbers_compare_apart(spark, seed):
    other = seed.withColumn("amount", F.regexp_replace("amount", r"(\.\d*?)0+$", "$1"))
    assert reconcile.diff_numeric(seed, other, ["id"], ["amount"], 4).count() == 0
    wrong = seed.withColumn("amount", F.when(F.col("id") == 1, "1.6").when(F.col("id") == 2, "n/a").otherwise(F.col("amount")))
    found = {tuple(r) for r in reconcile.diff_numeric(seed, wrong, ["id"], ["amount"], 4).collect()}
    assert found == {(1, "amount", "1.5000", "1.6000"), (2, "amount", "-2.2500", "n/a")}


def test_counts(spark):
    counts = lambda **kw: spark.createDataFrame(list(kw.items()), "table string, n long")
    found = {tuple(r) for r in reconcile.diff_counts(counts(a=5, b=1, c=2), counts(a=4, b=1, d=3)).collect()}
    assert found == {("a", 5, 4), ("c", 2, 0), ("d", 0, 3)}
    only = spark.createDataFrame([("a",), ("z",)], "table string")
    assert [r.table for r in reconcile.violating_structure_only(only, counts(a=4, b=1)).collect()] == ["a"]


def test_three_readings(spark, seed):
    bad = seed.filter("id <> 2")
    sides = {r.side for r in reconcile.diff_three(seed, bad, bad, ["id"], BYTES).collect()}
    assert sides == {"source", "target"}


def test_canonical(seed):
    row = reconcile.canonical(seed, ["id"], BYTES, {"amount": 2, "ratio": 1}).filter("id = '9007199254740993'").first()
    assert (row.id, row.payload, row.amount, row.ratio) == ("9007199254740993", "00", "0.00", "3.0")
