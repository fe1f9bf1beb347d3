"""Queries comparing a table with a damaged copy of itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from siteferry.operators import reconcile
from siteferry.plans.inputs import TABLES, derive, plain, table

# The copy lacks some rows, has cut texts, changed numbers and rows of its own, and doubles a few keys.
COPY = """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 89 = 0 THEN left(o_orderpriority, 2) ELSE o_orderpriority END
    AS o_orderpriority,
  CASE WHEN o_orderkey % 101 = 0 THEN NULL WHEN o_orderkey % 103 = 0 THEN '' ELSE o_orderstatus END AS o_orderstatus,
  CASE WHEN o_orderkey % 79 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
FROM {orders} WHERE o_orderkey % 97 <> 0
UNION ALL SELECT o_orderkey + 1000000000, o_custkey, o_orderpriority, o_orderstatus, o_totalprice
FROM {orders} WHERE o_orderkey % 83 = 0
UNION ALL SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus, o_totalprice
FROM {orders} WHERE o_orderkey % 211 = 0 AND o_orderkey % 97 <> 0"""

KEY = ["o_orderkey"]
TEXTS = ["o_orderpriority", "o_orderstatus"]


def _diff_rows(spark, sf_dir):
    return reconcile.diff_rows(table(spark, sf_dir, "orders"), derive(spark, sf_dir, COPY), KEY, TEXTS)


def _diff_keys(spark, sf_dir):
    states = reconcile.compare_keys(table(spark, sf_dir, "orders"), derive(spark, sf_dir, COPY), KEY, TEXTS)
    return states.groupBy("state").agg(F.count(F.lit(1)).alias("keys"))


def _truncation(spark, sf_dir):
    return _diff_rows(spark, sf_dir).filter("is_truncated").groupBy("column").agg(F.count(F.lit(1)).alias("cells"))


def _diff_numeric(spark, sf_dir):
    return reconcile.diff_numeric(
        table(spark, sf_dir, "orders"), derive(spark, sf_dir, COPY), KEY, ["o_totalprice"], 2
    )


def _diff_counts(spark, sf_dir):
    counts = lambda df: df.groupBy(F.col("o_orderpriority").alias("table")).agg(F.count(F.lit(1)).alias("n"))
    return reconcile.diff_counts(counts(table(spark, sf_dir, "orders")), counts(derive(spark, sf_dir, COPY)))


def _diff_three(spark, sf_dir):
    return reconcile.diff_three(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "orders"), derive(spark, sf_dir, COPY), KEY, TEXTS
    )


def _canonical(spark, sf_dir):
    return reconcile.canonical(
        table(spark, sf_dir, "customer"), ["c_custkey"], ["c_name", "c_mktsegment"], {"c_acctbal": 4}
    )


def _table_counts(spark, sf_dir):
    return reconcile.table_counts({name: table(spark, sf_dir, name) for name in TABLES})


_PAIRS = f"""
WITH c AS {plain(COPY)}, cn AS (SELECT o_orderkey, count(*) AS n FROM c GROUP BY 1),
one AS (SELECT c.* FROM c JOIN cn USING (o_orderkey) WHERE n = 1),
states AS (SELECT coalesce(o.o_orderkey, cn.o_orderkey) AS o_orderkey, cn.n,
  CASE WHEN cn.n > 1 THEN 'duplicate' WHEN cn.n IS NULL THEN 'missing' WHEN o.o_orderkey IS NULL THEN 'unexpected' END AS state
  FROM orders o FULL JOIN cn ON cn.o_orderkey = o.o_orderkey)"""

_WHOLE = """
SELECT o_orderkey, '*' AS "column",
  CASE state WHEN 'missing' THEN 'present' WHEN 'unexpected' THEN 'absent' ELSE 'unique' END AS expected,
  CASE state WHEN 'missing' THEN 'missing' WHEN 'unexpected' THEN 'unexpected row' ELSE n || ' rows' END AS actual"""

_CELLS = " UNION ALL ".join(
    f"""SELECT o.o_orderkey, '{c}' AS "column", hex(o.{c}) AS expected, hex(one.{c}) AS actual,
  coalesce(starts_with(o.{c}, one.{c}) AND length(one.{c}) < length(o.{c}), false) AS is_truncated
FROM orders o JOIN one USING (o_orderkey) WHERE o.{c} IS DISTINCT FROM one.{c}"""
    for c in TEXTS
)

_DIFF = f"{_PAIRS}{_WHOLE}, false AS is_truncated FROM states WHERE state IS NOT NULL UNION ALL {_CELLS}"

QUERIES = {
    "diff_rows": _diff_rows,
    "diff_keys": _diff_keys,
    "truncation": _truncation,
    "diff_numeric": _diff_numeric,
    "diff_counts": _diff_counts,
    "diff_three": _diff_three,
    "canonical": _canonical,
    "table_counts": _table_counts,
}

ORACLES = {
    "diff_rows": _DIFF,
    "diff_keys": f"""{_PAIRS}
SELECT state, count(*) AS keys FROM (SELECT s.o_orderkey, coalesce(s.state, CASE WHEN o.o_orderpriority IS DISTINCT FROM
  one.o_orderpriority OR o.o_orderstatus IS DISTINCT FROM one.o_orderstatus THEN 'changed' ELSE 'same' END) AS state
  FROM states s LEFT JOIN one USING (o_orderkey) LEFT JOIN orders o USING (o_orderkey)) GROUP BY state""",
    "truncation": f'SELECT "column", count(*) AS cells FROM ({_DIFF}) WHERE is_truncated GROUP BY 1',
    "diff_numeric": f"""{_PAIRS}{_WHOLE} FROM states WHERE state IS NOT NULL
UNION ALL SELECT o.o_orderkey, 'o_totalprice', CAST(CAST(o.o_totalprice AS DECIMAL(38,2)) AS VARCHAR),
  CAST(CAST(one.o_totalprice AS DECIMAL(38,2)) AS VARCHAR)
FROM orders o JOIN one USING (o_orderkey) WHERE CAST(o.o_totalprice AS DECIMAL(38,2)) <> CAST(one.o_totalprice AS DECIMAL(38,2))""",
    "diff_counts": f"""
SELECT coalesce(a.t, b.t) AS "table", coalesce(a.n, 0) AS expected, coalesce(b.n, 0) AS actual
FROM (SELECT o_orderpriority AS t, count(*) AS n FROM orders GROUP BY 1) a
FULL JOIN (SELECT o_orderpriority AS t, count(*) AS n FROM {plain(COPY)} GROUP BY 1) b ON a.t = b.t
WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
    "diff_three": f"SELECT *, 'target' AS side FROM ({_DIFF})",
    "canonical": """
SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, hex(c_name) AS c_name, hex(c_mktsegment) AS c_mktsegment,
  CAST(CAST(c_acctbal AS DECIMAL(38,4)) AS VARCHAR) AS c_acctbal FROM customer""",
    "table_counts": " UNION ALL ".join(f"""SELECT '{n}' AS "table", count(*) AS n FROM {n}""" for n in TABLES),
}
